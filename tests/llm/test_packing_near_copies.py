"""Near copies never share a bin."""

import collections
import random

from cairnmap.llm import packing


def test_near_copies_do_not_meet(spark):
    rng, rows = random.Random(2), []
    for g in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for i in range(6):
            changed = list(words)
            changed[rng.randrange(200)] = f"new{i}"
            rows.append((10 * g + i, " ".join(changed), f"s{i}"))
    docs = spark.createDataFrame([*rows, (90, None, "s"), (91, "", "s")], "doc_id long, text string, source string")
    got = packing.pack_near_copies(docs.repartition(3), capacity=1000).collect()
    assert len(got) == 26 and all(r.cluster is None for r in got if r.doc_id >= 90)
    assert len({r.cluster for r in got if r.doc_id < 90}) == 4
    bins = [(r.bin_id, r.doc_id // 10) for r in got if r.bin_id is not None]
    assert len(set(bins)) == len(bins)


def test_shards_are_counted_from_pieces_and_repeats_are_dealt(spark):
    """Long texts and repeated rows make as many shards as their pieces ask for, none much larger than the others."""
    long = spark.createDataFrame([(i, "w " * 600, "s") for i in range(40)], "doc_id long, text string, source string")
    same = spark.createDataFrame([(1, "one two three", "s")] * 3000, "doc_id long, text string, source string").repartition(3)
    for docs, capacity, pieces, words in ((long, 10, 2400, 24_000), (same, 10, 3000, 9000)):
        got = packing.pack_documents(docs, capacity=capacity, shard_pieces=100).collect()
        assert len(got) == pieces and sum(r.n_words for r in got) == words
        held = collections.Counter(r.bin_id >> 32 for r in got)
        assert len(held) >= pieces // 200 and max(held.values()) < 200


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g h", "s", 1), (1, "a b c d e f g h", "s", 2), (None, "a b c d e f g h", None, 3), (None, None, "s", 4), (2, "x " * 70, "s", 5), (3, "", "t", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster int")
    got = packing.pack_near_copies(docs, capacity=30).collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 2, None: 2, 2: 3, 3: 1}
    assert len({r.bin_id for r in got if r.doc_id == 1}) == 2
    assert sorted(r.n_words for r in got if r.doc_id == 2) == [10, 30, 30]
    assert [r.bin_id for r in got if r.n_words == 0] == [None, None]
    assert packing.pack_near_copies(docs.limit(0)).count() == 0
