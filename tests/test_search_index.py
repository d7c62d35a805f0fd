import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnmap.operators import search_index
from cairnmap.operators.views import search_match

WORDS = ["Harbour", "sail", "Été", "cat", "ok", "whisker", "anchors", "x1", "🙂🙂x"]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", f"n {rng.choice(WORDS)}"]), rng.choice([None, " ".join(rng.choice(WORDS) for _ in range(5))]), {"k": rng.choice(WORDS)}) for i in range(200)]
    return spark.createDataFrame(rows, "item_id long, name string, text string, metadata map<string,string>").repartition(3)


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "grams")
    search_index.add_to_index(path, items.filter("item_id < 120"))
    search_index.add_to_index(path, items.filter("item_id >= 120"))
    return path


@pytest.mark.parametrize("query", ["harbour", "SAIL cat", "arb ils", "ok", "x1 whisker", "", "  ", "nowhere", "été", "n harb", "🙂🙂X cat"])
def test_search_equals_the_scan(items, index, query):
    match = search_match(query, {"k": "a"}, F.col("name"), F.col("text"), F.col("metadata"))
    wanted = {r.item_id for r in items.filter(match).collect()}
    got = [r.item_id for r in search_index.search(items, index, query, {"k": "a"}).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_only_the_asked_grams_are_read(spark, index):
    plan = search_index.candidates(spark, index, "whisker")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(gram, [" in plan
    assert search_index.candidates(spark, index, "ok x1") is None


def test_texts_below_a_gram_have_no_postings(spark):
    rows = [(1, None, None), (2, "", "ab"), (3, "a", ""), (4, None, "abc")]
    found = search_index.postings(spark.createDataFrame(rows, "item_id long, name string, text string")).collect()
    assert {(r.item_id, r.gram) for r in found} == {(2, " ab"), (4, " ab"), (4, "abc")}


def test_postings_are_not_dealt_out(spark, tmp_path):
    texts = spark.createDataFrame([(i, None, "abcdef") for i in range(40)], "item_id long, name string, text string")
    context = spark.sparkContext
    context.setJobGroup("index", "index")
    search_index.add_to_index(str(tmp_path / "grams"), texts)
    context.setJobGroup("other", "other")
    jobs = context.statusTracker().getJobIdsForGroup("index")
    assert len(jobs) == 1 and len(context.statusTracker().getJobInfo(jobs[0]).stageIds) == 1


def test_postings_do_not_depend_on_pieces(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(None if i == 3 else i, None, rng.choice([None, "", "".join(rng.choice("abÉß🙂 \n\u0000") for _ in range(rng.randrange(40)))])) for i in range(120)]
    wanted = {(i, low[j:j + 3]) for i, _, t in rows for low in [(" " + (t or "")).lower()] for j in range(len(low) - 2)}
    for size in (1 << 21, 50):
        monkeypatch.setattr(search_index, "PIECE_BYTES", size)
        table = pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": [(" " + (r[2] or "")).lower().encode() for r in rows]})
        found = [(i, g) for b in search_index._grams(iter(table.to_batches())) for g, i in zip(b["gram"].to_pylist(), b["item_id"].to_pylist())]
        assert len(found) == len(wanted) and set(found) == wanted
    stored = search_index.postings(spark.createDataFrame(rows, "item_id long, name string, text string")).collect()
    assert {(r.item_id, r.gram) for r in stored} == wanted
