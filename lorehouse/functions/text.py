"""Text expressions: cleaning, keys, limits, splitting and answer labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed

# Unicode white space, and the characters that end a line.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}])"
WORD = r"[\p{L}\p{N}_]+"
TOPIC_WORD = r"[\p{L}\p{N}_-]+"
BLANK_LINE = rf"\n{SPACE}*\n"

# The same white space as plain characters, for trimming without a regex.
_SPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARACTERS = "".join(map(chr, _SPACE_CODES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(value: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(value, F.lit(SPACE_CHARACTERS))


def is_blank(value: Column) -> Column:
    """No character other than white space."""
    return strip(value) == ""


def words(value: Column) -> Column:
    """Tokens separated by white space."""
    return F.filter(F.split(value, rf"{SPACE}+"), lambda token: token != "")


def terms(value: Column) -> Column:
    """Lower-case word tokens in text order (the default analyzer)."""
    return F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0))


def canonical_name(name: Column) -> Column:
    """Key of an entity name."""
    return F.lower(strip(name))


def content_hash(text: Column) -> Column:
    """SHA-256 hex digest of the UTF-8 text."""
    return F.sha2(text, 256)


def slugify_topic(text: Column) -> Column:
    """Topic from the first significant words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOPIC_WORD), F.lit(0))
    significant = F.filter(
        tokens,
        lambda w: (F.length(w) >= fixed.TOPIC_WORD_MIN) & ~w.isin(*fixed.TOPIC_STOPWORDS),
    )
    chosen = F.when(F.size(significant) > 0, significant).otherwise(tokens)
    slug = F.array_join(F.slice(chosen, 1, fixed.TOPIC_WORDS), "-")
    return F.when(slug == "", F.lit(fixed.DEFAULT_TOPIC)).otherwise(slug)


def estimate_tokens(text: Column) -> Column:
    """Rough token count."""
    return F.floor(F.length(text) / fixed.CHARS_PER_TOKEN)


def worth_caching(text: Column, minimum: int = fixed.CACHE_MIN_TOKENS) -> Column:
    """Whether a prompt prefix is long enough to be cached."""
    return estimate_tokens(text) >= minimum


def head_tail(text: Column) -> Column:
    """Head and tail of a long text, the whole text otherwise."""
    cut = F.concat(
        F.left(text, F.lit(fixed.HEAD_CHARS)),
        F.lit(fixed.HEAD_TAIL_MARK),
        F.right(text, F.lit(fixed.TAIL_CHARS)),
    )
    return F.when(F.length(text) > fixed.HEAD_TAIL_MAX, cut).otherwise(text)


def is_truncated(text: Column) -> Column:
    """Whether a document body is longer than what is shown."""
    return F.length(text) > fixed.BODY_MAX


def truncate_body(text: Column) -> Column:
    """Document body as shown: a long one is cut and marked."""
    cut = F.concat(F.left(text, F.lit(fixed.BODY_MAX)), F.lit(fixed.BODY_MARK))
    return F.when(is_truncated(text), cut).otherwise(text)


def split_message(text: Column, limit: int = fixed.MESSAGE_LIMIT) -> Column:
    """Parts of at most ``limit`` characters, filled paragraph by paragraph."""
    blocks = F.filter(
        F.transform(F.split(strip(text), BLANK_LINE), strip), lambda block: block != ""
    )
    empty = F.array().cast("array<string>")

    def add(state: Column, block: Column) -> Column:
        done, last = state["done"], state["last"]
        flushed = F.when(last == "", done).otherwise(F.array_append(done, last))
        joined = F.when(last == "", block).otherwise(F.concat(last, F.lit("\n\n"), block))
        slices = F.regexp_extract_all(block, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        return (
            F.when(
                F.length(block) > limit,
                F.struct(F.concat(flushed, slices).alias("done"), F.lit("").alias("last")),
            )
            .when(F.length(joined) > limit, F.struct(flushed.alias("done"), block.alias("last")))
            .otherwise(F.struct(done.alias("done"), joined.alias("last")))
        )

    start = F.struct(empty.alias("done"), F.lit("").alias("last"))
    return F.aggregate(
        blocks,
        start,
        add,
        lambda s: F.when(s["last"] == "", s["done"]).otherwise(F.array_append(s["done"], s["last"])),
    )


def message_urls(text: Column) -> Column:
    """URLs of a message made of URLs only, else NULL."""
    tokens = words(text)
    only_urls = (F.size(tokens) > 0) & F.forall(tokens, looks_like_url)
    return F.when(only_urls, tokens)


def looks_like_url(token: Column) -> Column:
    """http(s) URL test for one token."""
    return strip(token).rlike("(?i)^https?://")


def literal_contains(haystack: Column, needle: Column) -> Column:
    """Case-insensitive literal substring test: no character acts as a wildcard."""
    return F.contains(F.lower(haystack), F.lower(needle))


def coerce_int(value: Column, default: int) -> Column:
    """Integer of a JSON scalar; booleans, junk and NULL give ``default``."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    as_text = F.try_variant_get(parsed, "$", "string")
    digits = F.regexp_replace(strip(as_text), "(?<=[0-9])_(?=[0-9])", "")
    from_text = F.when(digits.rlike(r"\A[+-]?[0-9]+\z"), digits.try_cast("bigint"))
    number = F.try_variant_get(parsed, "$", "double")
    toward_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    from_number = F.when(F.abs(number) < 9.2e18, toward_zero)
    exact = F.when(
        kind == "STRING", from_text
    ).when(
        kind == "BIGINT", F.try_variant_get(parsed, "$", "bigint")
    ).when(~kind.isin("BOOLEAN", "VOID") & ~kind.rlike("^(OBJECT|ARRAY)"), from_number)
    return F.coalesce(exact, F.lit(default).cast("bigint"))


def coerce_json_object(value: Column) -> Column:
    """Variant of a JSON-object string, NULL for anything else."""
    parsed = F.try_parse_json(value)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def parse_verdict(text: Column, allowed: Sequence[str] = fixed.VERDICTS) -> Column:
    """First allowed verdict in a judge's reply."""
    tokens = words(F.translate(F.lower(text), ",", " "))
    known = F.filter(tokens, lambda token: token.isin(*allowed))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def categorize_answer(answer: Column) -> Column:
    """Behaviour of an answer: refused, clarification or answered."""
    low = F.lower(answer)
    asks = F.lit(False)
    for marker in fixed.CLARIFY_MARKERS:
        asks = asks | F.contains(low, F.lit(marker))
    return (
        F.when(F.contains(low, F.lit(fixed.REFUSAL_PHRASE)), "refused")
        .when(asks & ~F.contains(low, F.lit(fixed.SOURCE_MARKER)), "clarification")
        .otherwise("answered")
    )
