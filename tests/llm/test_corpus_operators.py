"""Perplexity, Jaccard join, mixing, nearest neighbours, packing, URL filters and the pipeline."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnmap.llm import ann, jaccard, mixing, packing, perplexity, urls

SF = "/root/testdata/sf0.001"


def _shingles(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            o = len(a & b)
            if o and 100 * o >= 75 * (len(a) + len(b) - o):
                a_, b_ = root(i), root(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("block", [200, 1 << 21])
def test_jaccard_against_brute_force(spark, block):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(rng.randint(6, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (204, "one")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_shingles=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(rows)


def test_jaccard_shared_passages(spark):
    """Passages that many texts share connect them in one neighbourhood; counts within it take them apart again."""
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows = [new(30) for _ in range(6)], []
    for i in range(60):
        words = new(25) + rng.choice(passages) + new(20) + rng.choice(passages) + new(15)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: rng.choice([70, 90, 105, 120])] + new(rng.randint(0, 12))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {b: {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, block_shingles=b).collect()} for b in (400, 1 << 21)}
    assert found[400] == found[1 << 21] == _components(rows)
    named = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    one = named.select("id", F.lit(120).cast("long").alias("n_shingles"), F.lit(7).cast("long").alias("place"))
    places = jaccard.refined(one.union(one.filter("id < 9")), named)
    assert places.groupBy("place").count().agg(F.max("count")).first()[0] <= 4


def test_jaccard_repeated_ids(spark):
    """A doc_id with texts of different sizes links what is near either."""
    long, short = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(40)]
    rows = [(3, " ".join(long)), (3, " ".join(short)), (4, " ".join(short[:-1])), (5, " ".join(long[2:])), (6, "x y z")]
    for block in (100, 1 << 21):
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=block).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (4, 3), (5, 3), (6, 6)}


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (None, "q r", 0), (5, "x y z", 0), (5, "u v w", 0), (7, "u v w", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (5, 5), (5, 5), (7, 5)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_rtree_finds_all_that_could_link():
    rng = np.random.default_rng(1)
    counts = rng.poisson(2.0, (300, 64)).astype(np.int32)
    counts[150:] = counts[:150] + rng.integers(0, 2, (150, 64))
    sizes = counts.sum(axis=1)
    tree = jaccard.RTree(counts, sizes)
    for q in range(0, 300, 17):
        bound = np.minimum(counts, counts[q]).sum(axis=1)
        want = {int(i) for i in np.flatnonzero(bound >= jaccard.least_overlap(int(sizes[q]), sizes)) if 100 * sizes[i] >= 75 * sizes[q]}
        assert want <= set(tree.search(counts[q], int(sizes[q])).tolist())


def _kneser_ney(texts, vocabulary):
    """Plain dictionaries for the same model over texts of numbered words; returns the probability of (a, b, c)."""
    tri = collections.Counter()
    for tokens in texts:
        s = [0, 0, *tokens]
        tri.update(zip(s, s[1:], s[2:]))
    bi, uni = collections.Counter(), collections.Counter()
    for a, b, c in tri:
        bi[b, c] += 1
    for b, c in bi:
        uni[c] += 1

    def discounts(counts):
        n = [sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        found = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))

    def level(counts, d, key, lower):
        context, cut = collections.Counter(), lambda x: d[min(x, 3) - 1]
        for k, x in counts.items():
            context[key(k)] += x
        freed = collections.Counter()
        for k, x in counts.items():
            freed[key(k)] += cut(x)

        def p(k):
            c = key(k)
            if not context[c]:
                return lower(k)
            return max(counts[k] - cut(counts[k]), 0) / context[c] * (counts[k] > 0) + freed[c] / context[c] * lower(k)

        return p

    p1 = level(uni, discounts(uni), lambda k: (), lambda k: 1 / vocabulary)
    p2 = level(bi, discounts(bi), lambda k: k[0], lambda k: p1(k[1]))
    return level(tri, discounts(tri), lambda k: k[:2], lambda k: p2(k[1:]))


def test_quality_keeps_clean_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = perplexity.classify_quality(docs, labels, ["doc_id"]).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (3, "some words here", None, 1), (3, "some words here", None, 1)], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = perplexity.classify_quality(docs, labels, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert perplexity.classify_quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_mix_targets_and_order(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(report) == sorted(again) and len(report) == 600
    source = {i: s for i, _, s in rows}
    total, target, sizes = sum(r["size"] for r in report), {}, collections.Counter()
    for r in report:
        target[source[r.doc_id]] = (r.target, r.source_size)
        sizes[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r["size"]
    assert math.isclose(sum(t for t, _ in target.values()), total)
    assert all(t <= 3 * s + 1e-6 and abs(sizes[k] - t) <= 40 for k, (t, s) in target.items())
    order = mixing.mix_sources(docs.withColumn("position", F.lit("x")))
    placed = order.select("doc_id", "copy", "position").collect()
    assert [r.position for r in placed] == sorted(r.position for r in placed) and all(0 <= r.position <= 1 for r in placed)
    assert mixing.mix_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_schedules_are_inverted(spark, knots):
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        t = spark.range(1).select(mixing.time_of(F.lit(share), knots)).first()[0]
        area = lambda to: sum((min(to, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(to, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if to > a[0])
        assert math.isclose(area(t) / area(1.0), share, abs_tol=1e-9)


def test_neighbours_recall_and_rules(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    odd = [(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [float("nan")] * 64), (10**6 + 60, [1.0, None] + [0.0] * 62), (10**6 + 80, [1.0])]
    docs = spark.createDataFrame([(r.vec_id, r.embedding) for r in rows] + odd, "vec_id long, embedding array<float>")
    got = ann.search(docs, F.col("vec_id") % 20 == 0).collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = wanted = 0
    found = collections.defaultdict(dict)
    for r in got:
        assert r.vec_id != r.query_id
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = [i for i in sorted(range(len(ids)), key=lambda i: (-round(score[i], 12), ids[i])) if i != q][:20]
        mine = found[ids[q]]
        assert sorted(mine) == list(range(1, 21))
        hits, wanted = hits + len({ids[i] for i in best} & {v for v, _ in mine.values()}), wanted + 20
        assert all(math.isclose(s, float(x[q] @ x[np.flatnonzero(ids == v)[0]]), rel_tol=1e-9) for v, s in mine.values())
    assert hits / wanted >= 0.9 and max(found) < 10**6


def test_neighbours_few_rows(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(docs, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 20, (20, 1): 0, (20, 2): 1, (20, 3): 2}
    assert ann.search(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _plain_best_fit(sizes, sources, clusters, capacity, limit):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(room, b) for b, (room, held) in enumerate(bins) if room >= size and all(c != cluster for _, c in held) and sum(s == source for s, _ in held) < limit]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, []])
        bins[b][0] -= size
        bins[b][1].append((source, cluster))
        out.append(b)
    return out


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(3)
    sizes, sources, clusters = np.sort(rng.integers(1, 101, 400))[::-1], rng.integers(0, 90, 400) // 30, rng.integers(0, 130, 400)
    assert packing.pack(sizes, sources, clusters, 100, 2).tolist() == _plain_best_fit(sizes.tolist(), sources, clusters, 100, 2)


def test_packing_rows(spark):
    rows = [(1, "w " * 25, "a"), (2, None, None), (3, "", "a"), (4, "w " * 3, "b"), (4, "w " * 3, "b"), (5, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin_id", F.lit("x"))
    got = packing.pack_documents(docs, capacity=10).collect()
    assert sorted((r.doc_id, r.start, r.n_words) for r in got) == [(1, 0, 10), (1, 10, 10), (1, 20, 5), (2, 0, 0), (3, 0, 0), (4, 0, 3), (4, 0, 3), (5, 0, 2)]
    assert all((r.bin_id is None) == (r.n_words == 0) for r in got)
    for b in {r.bin_id for r in got if r.bin_id is not None}:
        held = [r for r in got if r.bin_id == b]
        assert sum(r.n_words for r in held) <= 10 and len({r.cluster for r in held}) == len(held)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [(1, "http://good.org/", link("mid.net")), (2, "http://bad-casino.net/", ""), (3, "http://farm.net/", link("bad-casino.net", "bad-casino.net")),
            (4, "http://mid.net/a", link("farm2.net")), (5, None, link("farm.net")), (6, "no url", None), (7, "http://x.example.org/es/1?q", "")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "block", "block", "allow", "allow", "allow", "block"]
    assert (got[7].host, got[7].path, got[7].rule) == ("x.example.org", "/es/1", "example.org/es/") and got[5].host == ""
    assert got[4].trust > 0 and got[3].distrust > 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sf = documents, SF
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        assert 0 < out.count(), name
        docs = spark.createDataFrame(out.collect(), documents.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    per_bin = packed.filter("bin_id IS NOT NULL").groupBy("bin_id").agg(F.sum("n_words").alias("n"), F.count("*").alias("p"), F.countDistinct("cluster").alias("c"))
    assert per_bin.filter("n > 2048 OR p <> c").count() == 0
    assert packed.agg(F.sum("n_words")).first()[0] == docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]


def test_leaf_groups_and_blocks_against_brute_force():
    group, blocks = ann.leaf_groups(np.array([3, 4, 0, 25, 2, 9]), 10)
    assert group.tolist() == [0, 0, 0, 1, 2, 3] and blocks.tolist() == [1, 3, 1, 1]
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    tree = ann.build_tree(x, leaf_rows=16)
    leaf = tree.leaf_of(x)
    counts = np.bincount(leaf, minlength=tree.leaves)
    some = tree.best_leaves(x[0], 1, counts, 60)
    assert counts[some].sum() >= 60 and counts[some[:-1]].sum() < 60
    bits = np.zeros(tree.leaves, bool)
    bits[some] = True
    asked = pd.DataFrame({"id": [0], "v": [x[0]], "bitmap": [np.packbits(bits).tobytes()]})
    rows = pd.DataFrame({"to_id": np.arange(400), "to_v": list(x), "to_leaf": leaf})
    got = pd.concat(ann.block_scores(asked, rows, 5))["vec_id"].tolist()
    seen = [i for i in range(1, 400) if leaf[i] in some]
    assert got == sorted(seen, key=lambda i: -(x[i] @ x[0]))[:5]
