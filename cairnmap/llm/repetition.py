"""Quality rules from repeated substrings of words inside one text.

A suffix array over the words of many texts at once (prefix doubling, the text being the first key)
gives the longest common prefix of neighbouring suffixes. Neighbours with a common prefix of at least
``min_words`` form LCP intervals; the longest repeat that starts at a word is the larger of its two
neighbour values, and the union of those spans is the union of all maximal repeated substrings. Texts
are judged where they are read: nothing is shuffled, and memory is bounded by a slice of texts or one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnmap.llm.bytetext import over_texts, split_words

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed value
# Repeats count from this many words on; at most this share of the words may be covered by
# them, and no single repeat may be longer than this many words.
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 8, 0.3, 200


def _first_of_run(fresh: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def _in_larger_run(fresh: np.ndarray) -> np.ndarray:
    """Marks members of runs of at least two."""
    return ~(fresh & np.append(fresh[1:], True))


def repeat_lengths(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word the length of the longest word sequence that starts there and occurs again in its text.

    ``codes`` are word hashes and ``owner`` the ascending text number of each word. A rank is the place in
    suffix order of the first suffix of a class; only classes of two or more are refined further. Two
    positions of a text with equal rank at level k agree in exactly 2^k words.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    last = np.searchsorted(owner, owner, side="right")
    order = np.lexsort((codes, owner))
    fresh = np.ones(n, bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = _first_of_run(fresh)
    levels, width, tied = [rank], 1, order[_in_larger_run(fresh)]
    while len(tied):
        then = tied + width
        second = np.where(then < last[tied], rank[np.minimum(then, n - 1)].astype(np.int64) + 1, 0)
        by = np.lexsort((second, rank[tied]))
        at, first, second = tied[by], rank[tied][by], second[by]
        group = np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        fresh = group.copy()
        fresh[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[at] = first + _first_of_run(fresh) - _first_of_run(group)
        levels.append(rank)
        tied, width = at[_in_larger_run(fresh)], 2 * width
    suffix = np.argsort(rank, kind="stable")
    left, right = suffix[:-1].copy(), suffix[1:].copy()
    end_left, end_right = last[left], last[right]
    prefix = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (left < end_left) & (right < end_right) & (end_left == end_right)
        same &= levels[k][np.minimum(left, n - 1)] == levels[k][np.minimum(right, n - 1)]
        for x in (prefix, left, right):
            x[same] += 1 << k
    lengths = np.zeros(n, np.int64)
    lengths[suffix[:-1]] = prefix
    lengths[suffix[1:]] = np.maximum(lengths[suffix[1:]], prefix)
    return lengths


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Marks the words inside any repeat of at least ``least`` words."""
    n = len(lengths)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths[at], -1)
    return np.cumsum(change[:-1]) > 0


def _duplicate_lines(text: bytes | None) -> int:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _spans(inside: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2])]


_ADDED = [pa.field("n_dup_lines", pa.int64()), pa.field("n_repeat_words", pa.int64()), pa.field("n_covered", pa.int64()),
          pa.field("longest_repeat", pa.int64()),
          pa.field("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _measure(min_words: int):
    def fn(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        words = split_words(texts)
        lengths = repeat_lengths(words.hashes, words.owner)
        threes, long_ = covered(lengths, 3), covered(lengths, min_words)
        per_text = lambda x: np.add.reduceat(np.append(x, 0), words.first[:-1]) * (words.counts > 0) if len(texts) else x
        longest = np.maximum.reduceat(np.append(lengths, 0), words.first[:-1]) * (words.counts > 0)
        marked = per_text(long_.astype(np.int64))
        spans = [_spans(long_[a:b]) if m else [] for a, b, m in zip(words.first, words.first[1:], marked)]
        added = [np.array([_duplicate_lines(t) for t in texts], np.int64), per_text(threes.astype(np.int64)), marked, longest]
        return pa.RecordBatch.from_arrays(
            [c for c, f in zip(piece.columns, piece.schema) if f.name != "text"]
            + [pa.array(x, pa.int64()) for x in added] + [pa.array(spans, _ADDED[-1].type)],
            schema=pa.schema([f for f in piece.schema if f.name != "text"] + _ADDED))

    return fn


def measure_repetition(docs: DataFrame, keep: list[str], text: str = "text", min_words: int = MIN_WORDS,
                       max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The columns ``keep`` of every row with its counts, spans and verdict.

    Adds word_chars, n_symbols, n_words, n_dup_lines, n_repeat_words, n_covered (words inside repeats of
    ``min_words`` or more), longest_repeat (words), repeats (maximal runs of covered words), base_failed
    (fewer than 50 words, or more than half of them in repeated 3-word windows) and kept (not base_failed,
    covered share at most ``max_covered``, longest repeat at most ``max_repeat``). A null or empty text has
    no words and fails. Rows are judged one by one, so ties and repeated rows need no rule; an empty table
    gives an empty table. Columns in ``keep`` must not bear the added names or ``text``.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(whole, F.lit(WORD)).cast("long").alias("n_words"), whole.cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    added = "n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, repeats array<struct<start: long, end: long>>"
    measured = slim.mapInArrow(over_texts(_measure(min_words)), f"{schema}, {added}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


ORACLE = f"""WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
    u AS MATERIALIZED (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    n AS (SELECT *, 3 AS width FROM (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g FROM u)
        UNION ALL SELECT *, {MIN_WORDS} FROM (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS g FROM u)
        UNION ALL SELECT *, {MAX_REPEAT + 1} FROM (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {MAX_REPEAT} FOLLOWING) AS g FROM u
            WHERE r IN (SELECT r FROM w WHERE len(words) > {MAX_REPEAT}))),
    again AS (SELECT r, i, width FROM (SELECT r, i, width, g, count(*) OVER (PARTITION BY r, width, g) AS c FROM n WHERE len(g) = width) WHERE c > 1),
    c AS (SELECT r, count(DISTINCT j) FILTER (width = 3) AS n_repeat, count(DISTINCT j) FILTER (width = {MIN_WORDS}) AS n_cov,
        count(*) FILTER (width = {MAX_REPEAT + 1}) AS n_long FROM (SELECT r, width, unnest(range(i, i + width)) AS j FROM again) GROUP BY 1),
    ln AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
        WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
        coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_cov, 0) AS n_cov, coalesce(n_long, 0) AS n_long
        FROM w LEFT JOIN c USING (r) LEFT JOIN ln USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_cov <= {MAX_COVERED} * n_words AND n_long = 0 AS kept
    FROM m"""
