"""Batch model calls with typed replies and an audit trail."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairnmap.functions.text import strip

MAX_ATTEMPTS = 3
_ATTEMPTS = "request_id string, attempt int, prompt string, raw_text string, parsed string"


def reply_body(raw: Column) -> Column:
    """The reply without surrounding white space and without a code fence."""
    text = strip(raw)
    inner = F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    inner = strip(F.regexp_replace(strip(inner), r"```$", ""))
    return F.when(text.startswith("```"), inner).otherwise(text)


def parse_reply(raw: Column, schema: str) -> Column:
    """Reply as a struct, or null when it is not JSON or a field is missing."""
    fields = T.StructType.fromDDL(schema).fieldNames()
    parsed = F.from_json(reply_body(raw), schema)
    complete = F.lit(True)
    for name in fields:
        complete = complete & parsed[name].isNotNull()
    return F.when(complete, parsed)


def _fits(value, kind: T.DataType) -> bool:
    """Whether a decoded JSON value has the wanted shape; whole numbers pass as floats."""
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(f.name in value and _fits(value[f.name], f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.IntegralType):
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _body(raw: str) -> str:
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].rstrip()
        text = text.removesuffix("```").strip()
    return text


def attempts(requests: DataFrame, call: Callable[[list[str]], list[str]], schema: str,
             max_attempts: int = MAX_ATTEMPTS, batch_rows: int = 8) -> DataFrame:
    """Every call made for ``requests(request_id, prompt)``, one row per attempt.

    ``call`` gets a batch of prompts and returns their replies; it runs in the
    tasks. A reply that does not parse to ``schema`` is asked for again. Store
    the result before deriving from it: replies may differ between calls.
    """
    kind = T.StructType.fromDDL(schema)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                waiting = list(zip(batch["request_id"][start:start + batch_rows], batch["prompt"][start:start + batch_rows]))
                rows = []
                for attempt in range(1, max_attempts + 1):
                    if not waiting:
                        break
                    again = []
                    for (request, prompt), raw in zip(waiting, call([p for _, p in waiting]), strict=True):
                        body = _body(raw)
                        try:
                            good = _fits(json.loads(body), kind)
                        except ValueError:
                            good = False
                        rows.append((request, attempt, prompt, raw, body if good else None))
                        if not good:
                            again.append((request, prompt))
                    waiting = again
                yield pd.DataFrame(rows, columns=["request_id", "attempt", "prompt", "raw_text", "parsed"])

    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), "prompt")
    # prompts often come out of an aggregation, which adaptive execution makes one partition
    spread = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "request_id")
    return spread.mapInPandas(ask, _ATTEMPTS)


def results(tries: DataFrame, schema: str, max_attempts: int = MAX_ATTEMPTS, by: str = "attempt") -> DataFrame:
    """The typed reply of each request's latest call that parsed, calls being numbered by ``by``; a request with none fails the job."""
    best = tries.groupBy("request_id").agg(F.max_by("parsed", F.when(F.col("parsed").isNotNull(), F.col(by))).alias("_json"))
    failed = F.concat(F.lit(f"no valid reply after {max_attempts} attempts for request "), F.col("request_id"))
    return best.withColumn(
        "_json", F.when(F.col("_json").isNull(), F.raise_error(failed)).otherwise(F.col("_json"))
    ).select("request_id", F.from_json("_json", schema).alias("reply"))
