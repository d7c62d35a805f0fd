"""Text preparation as column expressions; all of it stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# (?U) gives \s the Unicode white space class, as str.strip() and str.split() use.
_BLANK_RUN = r"(?U)\s+"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

PART_SEPARATOR = "\n\n"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def normalize_blanks(text: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, _BLANK_RUN, " "))


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space; looks no further than the first other character."""
    return ~F.coalesce(F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(False))


def nonempty(text: Column) -> Column:
    """The text itself, or null when it is empty."""
    return F.when(text != "", text)


def metadata_text(metadata: Column) -> Column:
    """``k: v, k: v`` in column order; null and empty values are left out, "0" is kept."""
    kept = F.filter(F.map_entries(metadata), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def embedding_text(name: Column, metadata: Column, extracted: Column) -> Column:
    """Name, metadata line and extracted text, whichever exist, separated by a blank line."""
    return F.concat_ws(
        PART_SEPARATOR, nonempty(name), nonempty(metadata_text(metadata)), nonempty(extracted)
    )


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def file_stem(path: Column) -> Column:
    """Last path component without its extension; a leading dot is part of the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


def within_budget(text: Column, max_tokens: int, prefix: str = "") -> Column:
    """Keep the first tokens of a text and put the task prefix in front.

    Tokens are white space separated words (no subword tokenizer is bundled);
    the words of the prefix count against the budget. Texts within the budget
    are kept as they are.
    """
    budget = max(max_tokens - len(prefix.split()), 0)
    if budget == 0:
        return F.lit(prefix)
    # One piece more than the budget tells whether there is a rest to drop.
    words = F.split(strip(text), _BLANK_RUN, budget + 1)
    cut = F.when(F.size(words) > budget, F.concat_ws(" ", F.slice(words, 1, budget))).otherwise(text)
    return F.concat(F.lit(prefix), cut)


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)
