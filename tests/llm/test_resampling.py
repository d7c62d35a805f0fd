"""Importance resampling against a plain version that hashes every feature with zlib."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cairnmap.llm import resampling

LOWER = {i: i + 32 for i in range(65, 91)}


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def _plain(rows, wanted):
    """(n_features, weight, score, rank) of every row, in order."""
    have = [_features(t) for _, t in rows]
    s = collections.Counter(b for _, f in have for b in f)
    t = collections.Counter(b for x in wanted for b in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for (i, _), (_, f) in zip(rows, have):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [k for k, (n, _) in enumerate(have) if n >= 20]
    fit.sort(key=lambda k: (-out[k][2], math.inf if rows[k][0] is None else rows[k][0]))
    for rank, k in enumerate(fit[:5 * len(fit) // 100], 1):
        out[k][3] = rank
    return out


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _corpus(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Haus", "meer", "été", "X", "rain", "9") for b in range(40)]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 60, 200])))) for i in range(n)]
    return rows + [(n, None), (n + 1, "word " * 5000), (n + 2, "z" * 300 + " " + "é" * 100 + " end" * 30)], [" ".join(rng.choice(vocabulary[:30]) for _ in range(40)) for _ in range(20)]


def test_buckets_equal_zlib():
    texts = ["", None, "one", "Two words", "a b c d", "ÄÖ ü9-x", "q" * 500 + " r", "\x7f\x00tail"]
    bucket, owner, words = resampling.feature_buckets([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        n, wanted = _features(t)
        assert words[i] == n and sorted(bucket[owner == i]) == sorted(wanted)


def test_against_plain_version(spark):
    rows, wanted = _corpus(400)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "item_id long, text string")
    docs = _docs(spark, rows).repartition(5)
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, target).collect()}
    assert got == {i: tuple(x) for (i, _), x in zip(rows, _plain(rows, wanted))}
    again = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs.repartition(2), target).collect()}
    assert got == again


def test_repeated_and_missing_ids(spark):
    """Rows that tie in score and id are all ranked, one after the other, up to the number drawn."""
    text = "alpha beta gamma delta " * 8
    rows = [(7, text)] * 130 + [(None, text)] * 40 + [(8, "other words " * 15)] * 30
    got = resampling.resample(_docs(spark, rows).repartition(4), _docs(spark, [(1, text)]).select("text")).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 200 and ranks == list(range(1, 11))
    drawn = collections.Counter((r.doc_id, r.score) for r in got if r["rank"] is not None)
    plain = collections.Counter((i, x[2]) for (i, _), x in zip(rows, _plain(rows, [text])) if x[3] is not None)
    assert drawn == plain


def test_empty_tables_and_clashing_names(spark):
    nothing = _docs(spark, [])
    target = nothing.select("text")
    assert resampling.resample(nothing, target).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert resampling.resample(nothing, target).count() == 0
    rows = [(i, f"w{i} common words here " * 6) for i in range(40)]
    odd = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, `a.b` string, score int, _row int, n_words int")
    got = resampling.resample(odd, target, ("doc_id", "a.b"))
    assert got.columns[:2] == ["doc_id", "a.b"] and got.filter("rank IS NOT NULL").count() == 2


@pytest.mark.parametrize("values", [[3], [5, 5, 5, 5], [-(1 << 62), 0, 1 << 62, 17, 17, -4]])
def test_bisection(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert resampling.highest_with(rows, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gains_favour_the_target():
    corpus, target = np.full(10, 100), np.zeros(10, int)
    target[3] = 50
    gain = resampling.gains(corpus, target)
    assert gain[3] > 0 and (np.delete(gain, 3) < 0).all()
