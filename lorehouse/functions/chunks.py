"""Chunk rules as array expressions: text in, ordered array of chunks out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse import schemas
from lorehouse.functions.text import BLANK_LINE, LINE_BREAK, SPACE, SPACE_CHARACTERS, is_blank, let, strip

_TEXTS = "array<string>"


def _no_texts() -> Column:
    return F.array().cast(_TEXTS)


def _filled(texts: Column) -> Column:
    return F.filter(F.transform(texts, strip), lambda text: text != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    return _filled(F.split(strip(text), BLANK_LINE))


def has_table(block: Column) -> Column:
    """Whether a line of the block starts with a pipe."""
    return F.contains(block, F.lit("|")) & block.rlike(rf"(?:\A|{LINE_BREAK}){SPACE}*\|")


def wrap_words(block: Column, size: int) -> Column:
    """Greedy word wrap: the regex engine takes the longest run that ends at a blank."""
    # a pattern for all white space is tried at every character; plain blanks need none
    blanks = F.translate(strip(block), SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))
    line = F.regexp_replace(blanks, " {2,}", " ")
    pattern = rf"[^ ](?s:.){{0,{size - 1}}}(?= |\z)|[^ ]+"
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def units(text: Column, size: int) -> Column:
    """Paragraphs, with long ones wrapped and tables left whole."""
    return F.flatten(
        F.transform(
            paragraphs(text),
            lambda block: F.when(has_table(block) | (F.length(block) <= size), F.array(block))
            .otherwise(wrap_words(block, size)),
        )
    )


def _carried(current: Column, overlap: int) -> Column:
    """Longest tail of whole units that fits into the overlap."""
    start = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def take(state: Column, unit: Column) -> Column:
        fits = state["open"] & (state["used"] + F.length(unit) <= overlap)
        return F.when(
            fits,
            F.struct(
                (state["taken"] + 1).alias("taken"),
                (state["used"] + F.length(unit) + 2).alias("used"),
                F.lit(True).alias("open"),
            ),
        ).otherwise(
            F.struct(state["taken"].alias("taken"), state["used"].alias("used"), F.lit(False).alias("open"))
        )

    return F.aggregate(F.reverse(current), start, take)


def pack(parts: Column, size: int, overlap: int) -> Column:
    """Fill chunks unit by unit; the last units of a chunk may be repeated in the next."""

    def state(done: Column, current: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), current.alias("current"), used.alias("used"))

    def add(s: Column, unit: Column) -> Column:
        grown = s["used"] + F.length(unit) + F.when(F.size(s["current"]) > 0, 2).otherwise(0)

        def flush() -> Column:
            # the separator of the first unit counts when chunks are full, as does the carry's
            extra = F.length(unit) + 2
            return let(
                _carried(s["current"], overlap),
                lambda carry: state(
                    F.array_append(s["done"], F.array_join(s["current"], "\n\n")),
                    F.array_append(
                        F.slice(s["current"], F.size(s["current"]) - carry["taken"] + 1, carry["taken"]),
                        unit,
                    ),
                    carry["used"] + extra,
                ),
            )

        return F.when((F.size(s["current"]) > 0) & (grown > size), flush()).otherwise(
            state(s["done"], F.array_append(s["current"], unit), grown)
        )

    start = state(_no_texts(), _no_texts(), F.lit(0))
    return F.aggregate(
        parts,
        start,
        add,
        lambda s: F.when(
            F.size(s["current"]) > 0, F.array_append(s["done"], F.array_join(s["current"], "\n\n"))
        ).otherwise(s["done"]),
    )


def generic_chunks(text: Column, size: int, overlap: int) -> Column:
    """Packed paragraphs."""
    return pack(units(text, size), size, overlap)


def sections(text: Column) -> Column:
    """Parts of a text that each start at a heading line."""
    lines = F.regexp_replace(text, LINE_BREAK, "\n")
    return _filled(F.split(lines, r"(?<=\n)(?=#{1,6}" + SPACE.replace("[", "(?!\\n)[", 1) + ")"))


def heading_chunks(text: Column, size: int, overlap: int) -> Column:
    """One chunk per section; long sections are packed; no headings means packed paragraphs."""
    return let(
        sections(text),
        lambda found: F.when(F.size(found) <= 1, generic_chunks(text, size, overlap)).otherwise(
            F.flatten(
                F.transform(
                    found,
                    lambda part: F.when(F.length(part) <= size, F.array(part)).otherwise(
                        generic_chunks(part, size, overlap)
                    ),
                )
            )
        ),
    )


def faq_chunks(text: Column) -> Column:
    """One question with its answer per chunk."""
    return let(
        sections(text),
        lambda found: F.when(F.size(found) > 1, found).otherwise(paragraphs(text)),
    )


def _meeting_block(header: Column, label: str, items: Column, size: int) -> Column:
    base = F.length(header) + 8 + len(label)
    prefix = F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise("")

    def close(lines: Column) -> Column:
        return F.concat(prefix, F.lit(f"{label}:\n"), F.array_join(lines, "\n"))

    def add(s: Column, item: Column) -> Column:
        line = F.concat(F.lit("- "), item)
        full = (F.size(s["lines"]) > 0) & (s["used"] + F.length(line) + 1 > size)
        return F.when(
            full,
            F.struct(
                F.array_append(s["done"], close(s["lines"])).alias("done"),
                F.array(line).alias("lines"),
                (base + F.length(line) + 1).alias("used"),
            ),
        ).otherwise(
            F.struct(
                s["done"].alias("done"),
                F.array_append(s["lines"], line).alias("lines"),
                (s["used"] + F.length(line) + 1).alias("used"),
            )
        )

    start = F.struct(_no_texts().alias("done"), _no_texts().alias("lines"), base.alias("used"))
    return F.aggregate(
        items,
        start,
        add,
        lambda s: F.when(
            F.size(s["lines"]) > 0, F.array_append(s["done"], close(s["lines"]))
        ).otherwise(s["done"]),
    )


def meeting_chunks(text: Column, attributes: Column, size: int, overlap: int) -> Column:
    """Decisions and action items, each chunk headed by date and participants."""
    notes = F.from_json(attributes, schemas.MEETING_ATTRIBUTES)

    def items(name: str) -> Column:
        return F.coalesce(notes[name], _no_texts())

    date = F.coalesce(notes["meeting_date"], F.lit(""))
    people = items("participants")
    header = F.array_join(
        F.filter(
            F.array(
                F.when(date != "", F.concat(F.lit(fixed.MEETING_DATE_PREFIX), date)),
                F.when(
                    F.size(people) > 0,
                    F.concat(F.lit(fixed.PARTICIPANTS_PREFIX), F.array_join(people, ", ")),
                ),
            ),
            lambda part: part.isNotNull(),
        ),
        "; ",
    )
    blocks = let(
        header,
        lambda head: F.concat(
            _meeting_block(head, fixed.DECISIONS_LABEL, items("decisions"), size),
            _meeting_block(head, fixed.ACTION_ITEMS_LABEL, items("action_items"), size),
        ),
    )
    nothing = (F.size(items("decisions")) == 0) & (F.size(items("action_items")) == 0)
    return F.when(nothing, heading_chunks(text, size, overlap)).otherwise(blocks)


def chunk_text(
    text: Column,
    doc_type: Column,
    attributes: Column,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> Column:
    """Chunks of a document by its type; a blank text has none."""
    by_type = (
        F.when(doc_type == "faq", faq_chunks(text))
        .when(doc_type == "meeting_notes", meeting_chunks(text, attributes, size, overlap))
        .when(doc_type.isin("regulation", "instruction"), heading_chunks(text, size, overlap))
        .otherwise(generic_chunks(text, size, overlap))
    )
    return F.when(is_blank(text), _no_texts()).otherwise(
        let(by_type, lambda c: F.when(F.size(c) == 0, F.array(strip(text))).otherwise(c))
    )
