"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a set of words with weight 1 + ln(count). The weight is cut into unit
cells (the last may be a fraction), and every cell is hashed into one of ``BINS``
bins, so that each bin stands for about the same weight. A cell of weight v
draws, from hashes of its own only, r and c from Gamma(2, 1) and b from U(0, 1):

    t = floor(ln v / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r.

The bin keeps the (cell, t) with the least a. Two texts keep the same one with
the probability of their generalised Jaccard similarity within the bin; bins
that are empty in both are not counted, so the rate of equal bins estimates the
generalised Jaccard similarity of the texts, each word being drawn once instead
of once per bin.

Everything is an expression over one row: the only shuffle brings neighbouring
documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse.llm.blocks import BLOCK, in_blocks, text_of, with_block
from lorehouse.session import once

BINS = 128  # a power of two
#: One row of 24 bytes per block is broadcast up to this number of blocks.
BROADCAST_BLOCKS = 100_000
_WORDS = r"[^\p{L}\p{N}]+"
#: A cell as one number: 7 bits of bin, 28 of ln a (in 2^-21), 28 of the kept value.
_BIN, _LN, _LOW = 56, 28, (1 << 28) - 1


def word_hashes(text: Column) -> Column:
    """Sorted hashes of a text's words; a text without words is one word itself."""
    words = F.array_remove(F.split(F.lower(text), _WORDS), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.sort_array(F.when(text.rlike(r"[\p{L}\p{N}]"), hashes).otherwise(F.array(F.xxhash64(text))))


def run_ends(hashes: Column) -> Column:
    """1-based places at which the runs of equal hashes end."""
    n = F.size(hashes)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(hashes, i - 1) != F.get(hashes, i)))


def _uniform(bits: Column, shift: int) -> Column:
    return (F.shiftright(bits, shift).bitwiseAND(F.lit((1 << 20) - 1)) + 0.5) / float(1 << 20)


def cells(hashes: Column, ends: Column) -> Column:
    """Sorted draws of all unit cells of all words.

    One step per intermediate value: expressions in a lambda are not shared, so
    each value is a field before it is used twice.
    """

    def counted(end: Column, i: Column) -> Column:
        count = end - F.coalesce(F.when(i > 0, F.get(ends, i - 1)), F.lit(0))
        return F.struct(F.get(hashes, end - 1).alias("word"), (F.ln(count.cast("double")) + 1.0).alias("weight"))

    def of_word(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.ceil(x["weight"]).cast("int")),
            lambda j: F.struct(F.xxhash64(x["word"], j).alias("p"), F.least(F.lit(1.0), x["weight"] - j + 1.0).alias("w")),
        )

    made = F.flatten(F.transform(F.transform(ends, counted), of_word))
    made = F.transform(
        made,
        lambda x: F.struct(
            x["p"].alias("p"), F.ln(x["w"]).alias("w"), F.xxhash64(x["p"], F.lit(1)).alias("one"), F.xxhash64(x["p"], F.lit(2)).alias("two")
        ),
    )
    made = F.transform(
        made,
        lambda x: F.struct(
            x["p"].alias("p"),
            x["w"].alias("w"),
            (-F.ln(_uniform(x["one"], 0) * _uniform(x["one"], 20))).alias("r"),
            F.ln(-F.ln(_uniform(x["one"], 40) * _uniform(x["two"], 0))).alias("ln_c"),
            _uniform(x["two"], 20).alias("b"),
        ),
    )
    made = F.transform(
        made,
        lambda x: F.struct(
            x["p"].alias("p"), x["r"].alias("r"), x["ln_c"].alias("ln_c"), x["b"].alias("b"), F.floor(x["w"] / x["r"] + x["b"]).alias("t")
        ),
    )

    def packed(x: Column) -> Column:
        ln_a = x["ln_c"] - x["r"] * (x["t"] - x["b"] + 1.0)
        level = ((ln_a + 64.0) * float(1 << 21)).cast("bigint")
        kept = F.xxhash64(x["p"], x["t"]).bitwiseAND(F.lit(_LOW))
        return F.shiftleft(x["p"].bitwiseAND(F.lit(BINS - 1)), _BIN) + F.shiftleft(level, _LN) + kept

    return F.sort_array(F.transform(made, packed))


def least_of_bins(sorted_cells: Column) -> Column:
    """Per filled bin the kept value: bin * 2^16 + 16 bits, as integers in order."""
    first = F.filter(
        sorted_cells,
        lambda x, i: (i == 0) | (F.shiftright(F.get(sorted_cells, i - 1), _BIN) != F.shiftright(x, _BIN)),
    )
    return F.transform(first, lambda x: (F.shiftright(x, _BIN) * 65536 + x.bitwiseAND(F.lit(65535))).cast("int"))


def signatures(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add one signature column per text; the steps are computed once each."""
    names = list(texts)

    def step(frame: DataFrame, to: str, made: dict[str, Column]) -> DataFrame:
        return once(frame, to, F.struct(*[c.alias(n) for n, c in made.items()]))

    df = step(df, "_hashes", {n: word_hashes(texts[n]) for n in names})
    df = step(df, "_ends", {n: run_ends(F.col("_hashes")[n]) for n in names})
    df = step(df, "_cells", {n: cells(F.col("_hashes")[n], F.col("_ends")[n]) for n in names})
    df = step(df, "_kept", {n: least_of_bins(F.col("_cells")[n]) for n in names})
    return df.select("*", *[F.col("_kept")[n].alias(n) for n in names]).drop("_hashes", "_ends", "_cells", "_kept")


def as_text(signature: Column) -> Column:
    """A signature as text: six hex digits per filled bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 6, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of equal bins among those filled in either signature."""

    def bins(s: Column) -> Column:
        return F.transform(s, lambda x: F.shiftright(x, 16))

    equal = F.size(F.array_intersect(left, right))
    filled = F.size(left) + F.size(right) - F.size(F.array_intersect(bins(left), bins(right)))
    return equal.cast("double") / filled


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, ``_row``, ``_ghost`` and ``next_text`` within blocks of ascending doc_id.

    Each block also holds a copy of the document that follows it (``_ghost``), so
    the window over a block sees every neighbour; after the last document comes the first.
    """
    rows, n = with_block(documents.select("doc_id", text_of().alias("text")), "doc_id")
    low = F.lit(-(1 << 63)).cast("bigint")
    keyed = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), low))
    everything = Window.orderBy(BLOCK)
    firsts = keyed.groupBy(BLOCK).agg(F.min("_key").alias("_key"))
    last = F.last(BLOCK).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn("_to", F.coalesce(F.lag(BLOCK).over(everything), last))
    if n <= BROADCAST_BLOCKS:  # else the planner decides by size
        firsts = F.broadcast(firsts)
    ghosts = (
        keyed.join(firsts, [BLOCK, "_key"])
        .groupBy("_to", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("_to").alias(BLOCK), F.lit(1).alias("_ghost"))
    )
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    order = Window.partitionBy(BLOCK).orderBy("_ghost", "doc_id", "text")
    return in_blocks(both, n).select(
        "*", F.row_number().over(order).alias("_row"), F.lead("text").over(order).alias("next_text")
    )


def fingerprint_digest(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends, in its last half, with the beginning of the next
    document. Null texts are empty; texts without words are one term; equal texts
    have equal fingerprints; equal doc_ids follow one another by text and null
    ones come first; the next document of a single row is itself; an empty table
    gives no rows; further columns are not read.
    """
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    rows = with_next(documents)
    rows = rows.withColumn("edited", F.when(F.col("_ghost") == 0, F.concat(F.left("text", n_chars - half), F.left("next_text", half))))
    rows = once(rows, "_edited", F.coalesce("edited", F.lit(""))).drop("edited", "next_text")
    signed = signatures(rows, {"own": F.col("text"), "changed": F.col("_edited")}).select(
        BLOCK,
        "_row",
        "_ghost",
        "doc_id",
        n_chars.cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "own",
        "changed",
    )
    following = F.lead("own").over(Window.partitionBy(BLOCK).orderBy("_row"))
    return (
        signed.withColumn("_next", following)
        .where("_ghost = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("_next")).alias("near_next"),
        )
    )
