"""Prefix members by exact counts over shards against plain sets."""

import collections
import random

import numpy as np

from cairnmap.llm import jaccard
from tests.llm.test_corpus_operators import _components


def _rows(n, seed=3):
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passages, rows = [new(40) for _ in range(4)], []
    for i in range(n):
        words = new(rng.randint(3, 50)) + rng.choice(passages) + new(rng.randint(0, 30))
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(len(words))] = "changed"
        rows.append((2 * i + 1, " ".join(words[: rng.choice([30, 60, 200])])))
    return rows


def test_members_of_several_texts(spark):
    rows = _rows(40)
    texts = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "CAST(text AS binary) AS text").repartition(3)
    sets = {i: set(jaccard.text_sets([t.encode()])[0].tolist()) for i, t in rows}
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id long, n_shingles long")
    often = collections.Counter(h for s in sets.values() for h in s)
    total = sum(map(len, sets.values()))
    bits = min(jaccard.CELL_BITS, max(32, total.bit_length() + 7))
    wanted = {}
    for i, s in sets.items():
        order = sorted((often[h], h >> (64 - bits)) for h in s)
        prefix = [(n << bits) | c for n, c in order[:len(s) + (-75 * len(s) // 100) + 1] if n > 1]
        if prefix:
            wanted[i] = prefix
    for shard in (total, 97):
        got = {r.id: r.tokens for r in jaccard.rare_members(texts, sizes, total, 5, 75, shard).collect()}
        assert got == wanted and len(got) < len(rows)


def test_small_shards_find_all_links(spark):
    rows = _rows(50, 4) + [(500, None), (501, ""), (502, "two words"), (503, "two  words"), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, shard_shingles=150, block_shingles=500).collect()}
    wanted = _components([r for r in rows if r[0] is not None])
    assert got.pop(None) == (1, 502) and got == wanted


def test_squeezed_numbers_come_back():
    for values in (np.array([0], np.uint64), np.arange(1000, dtype=np.uint64) * np.uint64(1 << 40), np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)):
        assert (jaccard._unsqueezed(jaccard._squeezed(values), len(values)) == values).all()
