import json

import pytest
from pyspark.sql import functions as F

from cairnmap.operators import generate

SCHEMA = "label string, keywords array<string>"
GOOD = '{"label": "a", "keywords": ["x"]}'


@pytest.mark.parametrize("raw,valid", [
    (GOOD, True), (f"```json\n{GOOD}\n```", True), (f"```\n{GOOD}\n```", True), (f"  {GOOD}\n", True), (f"```json\n{GOOD}", True),
    ("not json", False), ('{"label": "a"}', False), ("```", False), ("", False),
])
def test_fences_and_shapes(spark, raw, valid):
    parsed = spark.range(1).select(generate.parse_reply(F.lit(raw), SCHEMA).alias("r")).first().r
    assert (parsed is not None) is valid
    body = generate._body(raw)
    assert spark.range(1).select(generate.reply_body(F.lit(raw)).alias("b")).first().b == body


def requests(spark, n=20):
    return spark.createDataFrame([(str(i), f"prompt {i}") for i in range(n)], "request_id string, prompt string")


def test_a_bad_reply_is_asked_again(spark):
    def call(prompts):
        # Only the second call in a row for a batch is right.
        call.seen = getattr(call, "seen", 0) + 1
        return [GOOD if call.seen % 2 == 0 else "sorry" for _ in prompts]

    tries = generate.attempts(requests(spark).coalesce(1), call, SCHEMA).collect()
    assert len(tries) == 40
    assert {(r.attempt, r.parsed is not None) for r in tries} == {(1, False), (2, True)}


def test_three_failures_fail_the_job(spark):
    tries = generate.attempts(requests(spark, 2), lambda prompts: ["no"] * len(prompts), SCHEMA)
    assert tries.count() == 6
    with pytest.raises(Exception, match="no valid reply after 3 attempts"):
        generate.results(tries, SCHEMA).collect()


@pytest.mark.parametrize("value,valid", [
    ({"label": 5, "keywords": []}, False), ({"label": "a", "keywords": [1]}, False), ({"label": "a", "keywords": None}, False),
    ({"label": "a", "keywords": [], "more": 1}, True), ([], False),
])
def test_types_are_checked(spark, value, valid):
    tries = generate.attempts(requests(spark, 1), lambda prompts: [json.dumps(value)] * len(prompts), SCHEMA)
    assert (tries.agg(F.max("parsed")).first()[0] is not None) is valid


def test_nested_replies(spark):
    schema = "merges array<struct<cluster_ids:array<bigint>,rationale:string>>"
    reply = '{"merges": [{"cluster_ids": [1, 2], "rationale": "r"}]}'
    tries = generate.attempts(requests(spark, 1), lambda prompts: [reply], schema)
    assert generate.results(tries, schema).first().reply.merges[0].cluster_ids == [1, 2]
