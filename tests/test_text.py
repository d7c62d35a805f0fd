import pytest
from pyspark.sql import functions as F

from cairnmap.functions import text as X
from cairnmap.operators import materialize


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_parts_are_joined_by_blank_lines(spark):
    metadata = F.create_map(F.lit("color"), F.lit("red"), F.lit("empty"), F.lit(""), F.lit("score"), F.lit("0"))
    got = one(spark, X.embedding_text(F.lit("Cat"), metadata, F.lit("a text")))
    assert got == "Cat\n\ncolor: red, score: 0\n\na text"


def test_missing_parts_leave_no_gap(spark):
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, X.embedding_text(F.lit(None).cast("string"), empty, F.lit("x"))) == "x"
    assert one(spark, X.embedding_text(F.lit(""), empty, F.lit(""))) == ""


@pytest.mark.parametrize("path,stem", [("/a/b/photo.jpg", "photo"), ("x.tar.gz", "x.tar"), (".hidden", ".hidden"), ("/a/plain", "plain")])
def test_file_stem(spark, path, stem):
    assert one(spark, X.file_stem(F.lit(path))) == stem


@pytest.mark.parametrize("text", [" a ", "　a\t\n", "a"])
def test_strip_knows_unicode_blanks(spark, text):
    assert one(spark, X.strip(F.lit(text))) == text.strip()


@pytest.mark.parametrize("text,blank", [("", True), ("  \n", True), (None, True), (" x ", False)])
def test_blank(spark, text, blank):
    assert one(spark, X.is_blank(F.lit(text).cast("string"))) is blank


def test_budget_counts_the_prefix(spark):
    assert one(spark, X.within_budget(F.lit("a b  c d"), 4, "p: ")) == "p: a b c"
    assert one(spark, X.within_budget(F.lit("a b  c"), 4, "p: ")) == "p: a b  c"


def test_fallback_and_skip(spark):
    rows = spark.createDataFrame([(1, None, {}), (2, None, {}), (3, "n", {})], "row_id long, row_name string, metadata map<string,string>")
    paths = spark.createDataFrame([(1, "/x/scan_01.pdf")], "item_id long, original_path string")
    got = {r.item_id: r.text for r in materialize.representations(rows, None, paths).collect()}
    assert got == {1: "scan_01", 3: "n"}
