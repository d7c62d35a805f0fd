"""License scans through a positional index of rare template words, in DataFrame functions only.

A template is a licence notice with a label and a mandatory key phrase. Document frequencies of all
template words are counted over the whole corpus; the highest-IDF words of each template, the key
phrase's own among them, form the index: word -> (template, offset). In each text every index word is
looked up, its postings give template starts by relative position, starts on which two index words agree are
kept, and one of them counts when the key phrase stands there word for word. All of that happens inside the row: the only shuffle carries one
partial count per template word and task, so no key can be hot and long texts stay where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_offset(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.key_words)


def phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, text, base)


# The base phrases and their labels.
BASE = (
    phrase("gpl", "gnu general public license", True),
    phrase("apache", "apache license", True),
    phrase("cc-by", "cc by", True),
    phrase("mit", "mit license", True),
)

# Notices of public licences, lower case, punctuation dropped.
NOTICES = (
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("mpl", "mozilla public license"),
    phrase("epl", "eclipse public license"),
    phrase("bsd", "bsd 2 clause license"),
    phrase("bsd", "bsd 3 clause license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)

# Index words per template, besides the key phrase's two rarest words; two of them must agree on a start.
INDEX_WORDS = 3
# Share of a template's IDF mass that has to stand at its place.
MIN_COVERAGE = 0.6
# A start may lie before the text's first word; the bias keeps its code positive.
_START_BITS = 32
_START_BIAS = 1 << 16


def licence_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_idf(docs: DataFrame, templates, text: str = "text") -> dict[str, float]:
    """IDF of every template word over all rows: ln((rows + 1) / (rows with the word + 1)) + 1.

    At most one row per template word comes to the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), licence_words(F.col(text)))
    marked = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    rows = counts.get("", 0)
    return {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def rare_words(template: Template, idf: dict[str, float], n: int = INDEX_WORDS) -> list[str]:
    """The template's index words: its rarest ones and the two rarest of its key phrase; ties by the alphabet."""
    rank = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))
    return list(dict.fromkeys(rank(template.key_words)[:2] + rank(template.words)[:n]))


def scan_licenses(docs: DataFrame, text: str = "text", templates=BASE + NOTICES,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Add ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``matches``.

    ``matches`` holds (label, base, start, coverage) of every template found, ``coverage`` being the share
    of the template's IDF mass at its place; base templates are their own key phrase, so they count
    wherever they stand. A notice whose key phrase opens the text may start before it, at a negative start; the words
    before the text count as not covered. A null or empty text has no words: zero counts, empty labels, null places, score 0.
    Rows are independent of each other, so repeated rows give repeated results; other columns are kept,
    except that columns with the result's names are replaced. An empty table gives an empty table.
    """
    templates = tuple(templates)
    idf = word_idf(docs, templates, text)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for word in rare_words(template, idf):
            for offset, w in enumerate(template.words):
                if w == word:
                    postings.setdefault(word, []).append((t, offset))
    index = F.create_map(*[x for w, found in sorted(postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(o).alias("o")) for t, o in found]))])
    known = F.array(*[F.struct(
        F.array(*map(F.lit, t.words)).alias("words"),
        F.array(*[F.lit(idf[w] / sum(idf[x] for x in t.words)) for w in t.words]).alias("weights"),
        F.array(*map(F.lit, t.key_words)).alias("key"), F.lit(t.key_offset).alias("at"),
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in templates])

    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    read = docs.select(*rest, licence_words(F.col(text)).alias("_w"))
    hits = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*postings), F.struct(i.alias("i"), w.alias("w")))),
                    lambda x: x.isNotNull())
    looked_up = read.select("*", hits.alias("_hits"))
    codes = F.flatten(F.transform("_hits", lambda h: F.transform(
        F.element_at(index, h["w"]),
        lambda p: F.shiftleft(p["t"], _START_BITS) + h["i"] - p["o"] + _START_BIAS)))
    # postings of different index words are intersected: a start needs two of them, as every key phrase has
    sorted_ = looked_up.select("*", F.array_sort(codes).alias("_codes"))
    met = F.filter("_codes", lambda c, i: (i > 0) & (c == F.get("_codes", i - 1)))
    aligned = sorted_.select("*", F.array_distinct(met).alias("_starts"))

    def verify(code: Column) -> Column:
        start = code.bitwiseAND(F.lit((1 << _START_BITS) - 1)).cast("int") - _START_BIAS
        template = F.element_at(known, (F.shiftright(code, _START_BITS) + 1).cast("int"))
        same = F.transform(template["words"], lambda word, j: (start + j >= 0) & F.coalesce(
            F.get("_w", start + j) == word, F.lit(False)))
        covered = F.aggregate(F.zip_with(same, template["weights"], lambda m, x: F.when(m, x).otherwise(0.0)),
                              F.lit(0.0), lambda a, x: a + x)
        at = start + template["at"]
        held = (at >= 0) & (F.slice("_w", F.greatest(at, F.lit(0)) + 1, F.size(template["key"])) == template["key"])
        return F.when(held, F.struct(template["label"].alias("label"), template["base"].alias("base"),
                                     start.cast("long").alias("start"), covered.alias("coverage")))

    places = F.filter(F.transform("_starts", verify),
                      lambda m: m.isNotNull() & (m["base"] | (m["coverage"] >= min_coverage)))
    matched = aligned.select("*", F.when(F.size("_starts") > 0, places).otherwise(F.filter(
        F.array(F.struct(F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).cast("long").alias("start"),
                         F.lit(0.0).alias("coverage"))), lambda m: F.lit(False))).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return matched.select(
        *rest, F.size("_w").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)), 6).alias("score"),
        "matches",
    )


def oracle(templates=BASE + NOTICES, min_coverage: float = MIN_COVERAGE) -> str:
    """DuckDB SQL of the query's rows: every place of every key phrase, found without an index."""
    rows = ", ".join(
        f"({i}, '{t.label}', {str(t.base).lower()}, {t.words}, {t.key_words}, {t.key_offset})" for i, t in enumerate(templates))
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
        tpl(t, label, base, tw, key, skip) AS (VALUES {rows}),
        tw AS (SELECT t, unnest(tw) AS word, generate_subscripts(tw, 1) AS j FROM tpl),
        df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, unnest(words) AS word FROM w) GROUP BY 1),
        idf AS (SELECT DISTINCT tw.word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1 AS x
            FROM tw LEFT JOIN df USING (word)),
        mass AS (SELECT t, sum(x) AS total FROM tw JOIN idf USING (word) GROUP BY 1),
        firsts AS (SELECT r, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
            WHERE list_has_any(words, (SELECT list(DISTINCT key[1]) FROM tpl))),
        places AS (SELECT r, words, t, label, base, i - 1 - skip AS start FROM firsts JOIN tpl ON word = key[1]
            WHERE words[i:i + len(key) - 1] = key),
        cov AS (SELECT r, p.t, label, base, start, sum(CASE WHEN start + j >= 1 AND words[greatest(start + j, 1)] = word THEN x ELSE 0 END) / any_value(total) AS c
            FROM places p JOIN tw USING (t) JOIN idf USING (word) JOIN mass USING (t) GROUP BY ALL),
        kept AS (SELECT * FROM cov WHERE base OR c >= {min_coverage}),
        per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
            max(start) FILTER (base) AS last_word, max(c) AS score,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM kept GROUP BY 1)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
        FROM w LEFT JOIN per USING (r)"""
