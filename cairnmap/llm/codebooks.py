"""Vector codes: product quantisation whose Lloyd rounds rescan a part only where bounds leave its nearest entry open.

Vectors become whole numbers, so every distance that decides is exact. A vector is cut into parts, and each part position
has a codebook. Per part a row keeps its entry's index, an upper bound on the distance to that entry and a lower
bound on the distance to all others, each with the round it was measured in. All codebooks since the first are kept (a few
entries a round), so a bound is carried to the present by the true distance between where an entry stood in
the bound's round and where it stands now: the norm of the sum of its moves, which is never more, and often much less, than the
sum of their norms. Only if the bounds overlap is the own distance measured anew, and only if they still do are all
entries. A round is one pass over the rows; tasks return sums per entry beside the rows, so nothing else is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.session import discard, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# Relative allowance for rounding in bounds; what lies closer is measured.
SLACK = 1e-9

_HELD = "code binary, upper binary, lower binary, upper_round binary, lower_round binary, rescans long"


@dataclass
class Held:
    """What is known of each row's parts, arrays of rows x parts; ``rescans`` counts full searches per row."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_round: np.ndarray
    lower_round: np.ndarray
    rescans: np.ndarray

    @classmethod
    def unknown(cls, rows: int, parts: int) -> Held:
        small = lambda: np.zeros((rows, parts), np.uint8)
        return cls(small(), np.full((rows, parts), np.inf, np.float32), np.zeros((rows, parts), np.float32), small(), small(), np.zeros(rows, np.int64))

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> Held:
        kinds = {"code": np.uint8, "upper": np.float32, "lower": np.float32, "upper_round": np.uint8, "lower_round": np.uint8}
        found = [np.frombuffer(b"".join(batch.column(c).to_pylist()), k).reshape(-1, parts).copy() for c, k in kinds.items()]
        return cls(*found, batch.column("rescans").to_numpy(zero_copy_only=False).copy())

    def columns(self) -> dict[str, pa.Array]:
        out = {c: pa.array([r.tobytes() for r in getattr(self, c)], pa.binary()) for c in ("code", "upper", "lower", "upper_round", "lower_round")}
        return out | {"rescans": pa.array(self.rescans, pa.int64())}


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(axis=-1)


def _others(moved: np.ndarray) -> np.ndarray:
    """For each round and entry the largest move among the other entries."""
    if moved.shape[1] < 2:
        return np.zeros_like(moved)
    ranked = np.argsort(moved, axis=1)
    first, second = np.take_along_axis(moved, ranked[:, -1:], 1), np.take_along_axis(moved, ranked[:, -2:-1], 1)
    return np.where(np.arange(moved.shape[1]) == ranked[:, -1:], second, first)


def reassign(x: np.ndarray, held: Held, history: np.ndarray) -> None:
    """Bring ``held`` to the newest codebooks: nearest entry of every part, ties to the lower index.

    ``x`` is rows x parts x width and ``history`` rounds x parts x entries x width, whole numbers.
    """
    now = len(history) - 1
    for p in range(x.shape[1]):
        book, part = history[now, p], x[:, p]
        moved = np.sqrt(squared(history[:, p], book).astype(float))  # since each round, of each entry
        code = held.code[:, p].astype(np.int64)
        drift = _others(moved)[held.lower_round[:, p], code]
        upper = held.upper[:, p] + moved[held.upper_round[:, p], code]
        reach = held.lower[:, p].astype(float)
        lower = reach - drift

        def open_(rows: np.ndarray, reach=reach, lower=lower, upper=upper, drift=drift) -> np.ndarray:
            slack = SLACK * (1 + upper[rows] + np.where(np.isinf(reach[rows]), 0, reach[rows]) + drift[rows])
            return rows[~(upper[rows] + slack < lower[rows])]

        rows = open_(np.arange(len(x)))
        upper[rows] = np.sqrt(squared(part[rows], book[code[rows]]).astype(float))
        held.upper[rows, p], held.upper_round[rows, p] = np.nextafter(upper[rows].astype(np.float32), np.float32(np.inf)), now
        rows = open_(rows)
        if not len(rows):
            continue
        all_ = squared(part[rows][:, None, :], book[None])
        code = all_.argmin(axis=1)
        at = np.arange(len(rows))
        nearest = all_[at, code]
        second = np.full(len(rows), np.inf)
        if len(book) > 1:
            second = np.sqrt(np.partition(all_, 1, axis=1)[:, 1].astype(float))
        held.code[rows, p] = code
        held.upper[rows, p] = np.nextafter(np.sqrt(nearest.astype(float)).astype(np.float32), np.float32(np.inf))
        held.lower[rows, p] = np.nextafter(second.astype(np.float32), np.float32(0))
        held.lower[rows[np.isinf(second)], p] = np.inf
        held.upper_round[rows, p] = held.lower_round[rows, p] = now
        held.rescans[rows] += 1


def _round(history: np.ndarray, keep: int):
    """One pass: rows with their new bounds, then the task's sums as (slot, value); slot 0 of an entry is its count."""
    _, parts, entries, width = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        names = kinds = None
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(-1, parts, width).astype(np.int64)
            held = Held.read(batch, parts) if "code" in batch.schema.names else Held.unknown(len(x), parts)
            reassign(x, held, history)
            for p in range(parts):
                by = np.argsort(held.code[:, p], kind="stable")
                present, first = np.unique(held.code[by, p], return_index=True)
                if len(first):
                    sums[p, present, 1:] += np.add.reduceat(x[by, p], first, axis=0)
                    sums[p, present, 0] += np.diff(np.append(first, len(by)))
            columns = {n: batch.column(n) for n in [f"_k{i}" for i in range(keep)] + ["x"]} | held.columns()
            columns |= {"slot": pa.nulls(len(x), pa.int64()), "value": pa.nulls(len(x), pa.int64())}
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            names, kinds = out.schema.names, out.schema.types
            yield out
        if names:
            at = np.flatnonzero(sums.ravel())
            last = {"slot": pa.array(at), "value": pa.array(sums.ravel()[at])}
            yield pa.RecordBatch.from_arrays([last.get(n, pa.nulls(len(at), k)) for n, k in zip(names, kinds)], names=names)

    return run


def _final(history: np.ndarray, keep: int):
    """The last assignment: code and exact error of every row."""
    _, parts, _, width = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(-1, parts, width).astype(np.int64)
            held = Held.read(batch, parts) if "code" in batch.schema.names else Held.unknown(len(x), parts)
            reassign(x, held, history)
            near = history[-1][np.arange(parts), held.code]  # rows x parts x width
            columns = {f"_k{i}": batch.column(f"_k{i}") for i in range(keep)}
            columns |= {"code": pa.array([r.tobytes().hex() for r in held.code], pa.string()), "error": pa.array(squared(x, near).sum(axis=1), pa.int64()),
                        "rescans": pa.array(held.rescans, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _integers(scale: int, limit: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            whole = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int32)
            columns = {f"_k{i}": batch.column(f"_k{i}") for i in range(keep)} | {"x": pa.array([r.tobytes() for r in whole], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _usable(vector: Column, parts: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite


@dataclass
class Codes:
    """``rows``: the kept columns, code, error, rescans; ``codebooks``: parts x entries x width, None without rows."""

    rows: DataFrame
    codebooks: np.ndarray | None

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable rows with the columns ``keep``, and the codebooks.

    A component x becomes floor(scale * x). Each part position's codebook starts as that part of the rows with the smallest ids
    (``entries`` of them, or all rows if fewer; ids null last, repeated ids by their components). A round assigns every
    part to its nearest entry (ties to the lower index) and moves each entry to the floored mean of its parts; unused entries stay.
    Afterwards all parts are assigned once more. Rows take no part whose vector is null, holds a null or non-finite component, or has no
    length that is a multiple of ``parts``; nor those whose length differs from that of the smallest id's vector. Components beyond +-limit (64
    components: 2^27, which is 32,768 before scaling) count as the limit, so squares stay within 64 bits. Repeated rows are
    coded alike; an empty table gives an empty table. Columns outside ``keep`` are ignored, whatever their names.
    """
    if not 0 < entries <= 256 or rounds > 255:
        raise ValueError("at most 256 entries and 255 rounds")
    names = [f"_k{i}" for i in range(len(keep))]
    doubles = F.col(f"`{vec_col}`").cast("array<double>")
    base = vectors.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{id_col}`").alias("_id"), doubles.alias("vector"))
    base = base.filter(_usable(F.col("vector"), parts))
    order = [F.col("_id").asc_nulls_last(), "vector"]
    first = base.select("_id", "vector").orderBy(*order).first()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name in names)
    out = [*[F.col(n).alias(c) for c, n in zip(keep, names)], "code", "error", "rescans"]
    if first is None:
        return Codes(vectors.sparkSession.createDataFrame([], f"{kinds}, code string, error long, rescans long").select(*out), None)
    length = len(first["vector"])
    base, limit = base.filter(F.size("vector") == length), int((2**60 // length) ** 0.5)
    starts = base.orderBy(*order).limit(entries).select("vector").toPandas()["vector"]
    start = np.clip(np.floor(np.stack(starts.to_numpy()) * scale), -limit, limit).astype(np.int64)
    history = start.reshape(len(start), parts, -1).transpose(1, 0, 2)[None]
    _, _, k, width = history.shape

    table = written(base.select(*names, "vector").mapInArrow(_integers(scale, limit, len(keep)), f"{kinds}, x binary"))
    for _ in range(rounds):
        after = written(table.mapInArrow(_round(history, len(keep)), f"{kinds}, x binary, {_HELD}, slot long, value long"))
        # the tasks' sums, one row per entry and component; means in unbounded whole numbers
        moved = after.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
        sums = np.zeros(parts * k * (width + 1), object)
        for row in moved:
            sums[row["slot"]] = int(row["v"])
        sums = sums.reshape(parts, k, width + 1)
        book = history[-1].copy()
        for p, e in zip(*np.nonzero(sums[:, :, 0])):
            book[p, e] = [int(v) // int(sums[p, e, 0]) for v in sums[p, e, 1:]]
        history = np.concatenate([history, book[None]])
        discard(table)
        table = after.filter("slot IS NULL").drop("slot", "value")
        table._written_to = after._written_to
    coded = written(table.mapInArrow(_final(history, len(keep)), f"{kinds}, code string, error long, rescans long"))
    discard(table)
    return Codes(coded.select(*out), history[-1])


def with_group_error(coded: DataFrame, label: str) -> DataFrame:
    """``label_error``: the errors of the rows with an equal label summed, null labels together.

    Sums are partial per task; the join back is an ordinary one on the label, so the rows of a hot label can be split.
    """
    named = coded.withColumn("_null", F.col(label).isNull()).withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("")))
    sums = named.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"))
    return named.join(sums, ["_null", "_label"]).drop("_null", "_label")


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    codes = encode(vectors, ("vec_id", "label"))
    sha = F.lit(codes.sha256() if codes.codebooks is not None else None).cast("string")
    return with_group_error(codes.rows, "label").select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS c FROM kept, range({parts}) r(p)),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM x
        WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, x.p, e,
            list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} b USING (p)) GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""m{r + 1} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM (SELECT p, e, j, sum(y) AS s, count(*) AS n
            FROM (SELECT x.p, e, unnest(c) AS y, generate_subscripts(c, 1) AS j FROM x JOIN a{r} USING (vec_id, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c{r + 1} AS MATERIALIZED (SELECT p, e, CASE WHEN m.c IS NULL THEN o.c ELSE list_transform(m.c, lambda y: CAST(y AS BIGINT)) END AS c FROM c{r} o LEFT JOIN m{r + 1} m USING (p, e))""")
    return "WITH " + ",\n    ".join(steps) + f""",
    coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""
