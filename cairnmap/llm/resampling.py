"""Importance resampling: documents whose hashed word n-grams look like those of a target are drawn more often.

1. Features are all runs of one to three words; a feature's bucket is its CRC-32 modulo the number of buckets. One pass over
   the documents and one over the target count the buckets; a task sends one count per bucket.
2. The gains of all buckets are one array of fixed size. A second pass sums a document's gains from it; nothing is joined.
3. A document's score is its weight plus Gumbel noise from a hash of its id, so the highest scores are a draw without
   replacement. The scores are written once; the score of the last document drawn is found by bisection, each
   job counting rows over the written table, and ties at that score by bisection over the document ids.
4. Only the drawn rows are moved: range partitions in the order of scores, whose sizes turn places within them into ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.functions.frames import from_pandas
from cairnmap.llm.bytetext import LOWER, over_texts, split_words, text_chunks
from cairnmap.session import written

BUCKETS, LONGEST = 10_000, 3
SCALE = 1_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
# Levels of bisection that one count job decides.
LEVELS = 4
# Drawn rows per range partition.
PARTITION_ROWS = 1 << 20
# Bytes of a word that are hashed for many words at once; what is longer goes on alone.
STEPS = 48

# Words are ASCII letters, digits and everything beyond ASCII.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _crc_table()


def _step(register: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


def extend(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes from ``start`` to ``end`` of each entry."""
    order = np.argsort(start - end, kind="stable")  # longest first, so those still open are a prefix
    at, length, out = start[order], (end - start)[order], register[order]
    for k in range(min(STEPS, int(length[0]) if len(length) else 0)):
        still = int(np.searchsorted(-length, -k, side="left"))
        out[:still] = _step(out[:still], data[at[:still] + k])
    for i in range(int(np.searchsorted(-length, -STEPS, side="left"))):
        out[i] = crc32(data[at[i] + STEPS:at[i] + length[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    found = np.empty_like(out)
    found[order] = out
    return found


def feature_buckets(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's number, words of each text); features of a text are not in order."""
    w = split_words(texts, BREAKS, LOWER)
    data, owner = LOWER[w.data], w.owner
    at, register = np.arange(len(owner)), np.full(len(owner), 0xFFFFFFFF, np.uint32)
    last, found, owners = w.first[1:][owner], [], []
    for n in range(longest):
        if n:
            more = at + n < last[at]
            at, register = at[more], _step(register[more], np.uint32(0x20))
        register = extend(register, data, w.start[at + n], w.end[at + n])
        found.append((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), w.counts


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_chunks(batches):
            total += np.bincount(feature_buckets(texts, buckets, longest)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    slim = docs.select(F.col(f"`{text}`").cast("binary").alias("text"))
    rows = slim.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:  # at most one per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the scaled log ratio of the smoothed shares, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(scale * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _weigh(gain: np.ndarray, longest: int):
    """Words, features and summed gains of every text, beside the other columns of its row."""

    def weigh(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        bucket, owner, words = feature_buckets(texts, len(gain), longest)
        sums = np.bincount(owner, weights=gain[bucket], minlength=len(texts))  # whole numbers far below 2^53
        kept = [(c, f.name) for c, f in zip(piece.columns, piece.schema) if f.name != "text"]
        added = {"n_words": words, "n_features": np.bincount(owner, minlength=len(texts)), "weight": sums}
        return pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(np.asarray(x).astype(np.int64)) for x in added.values()],
                                          names=[n for _, n in kept] + list(added))

    return over_texts(weigh)


def gumbel(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise from a hash of seed and id, rounded down; a null id hashes like an empty one."""
    head = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256).substr(1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def highest_with(rows: DataFrame, column: str, count: int) -> int:
    """The largest number that at least ``count`` rows reach in the long ``column``; ``rows`` has so many.

    Bisection between the smallest and the largest value: a job counts the rows at the midpoints of several levels.
    """
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"] + 1  # enough rows reach low, none reach high
    while high - low > 1:
        parts = 1 << LEVELS
        probes = sorted({low + (high - low) * i // parts for i in range(1, parts)} - {low})
        found = rows.agg(*[F.count_if(F.col(column) >= F.lit(p)).alias(f"c{i}") for i, p in enumerate(probes)]).first()
        reached = [p for i, p in enumerate(probes) if found[f"c{i}"] >= count]
        missed = [p for i, p in enumerate(probes) if found[f"c{i}"] < count]
        low, high = max([low, *reached]), min([high, *missed])
    return low


def resample(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, scale: int = SCALE) -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``, all long.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn: those with the highest scores, ties to the
    smaller ``doc_id`` (a whole number; null last). ``rank`` is their place from 1; it is null for the others. A null or
    empty text has no words, no features and weight 0. Rows that repeat an id have the same noise; rows that also
    have the same weight are ranked one after the other in no stated order. An empty table gives an empty table; an empty target smooths to
    equal shares. Columns outside ``keep`` are ignored, whatever their names; ``keep`` must not hold the added names.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), scale)
    names = [f"_k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{doc_id}`").cast("long").alias("_id"),
                       F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").cast("binary").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema if f.name != "text"}
    schema = ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", n_words long, n_features long, weight long"
    weighed = slim.mapInArrow(_weigh(gain, longest), schema)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed, scale)))
    ranked = scored.withColumn("rank", F.lit(None).cast("long"))
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    if drawn:
        last = highest_with(fit, "score", drawn)
        # the complement falls as the id rises, so smaller ids come first; rows without an id come last
        order = F.coalesce(F.bitwise_not("_id"), F.lit(-(1 << 63)))
        tied = fit.filter(F.col("score") == last).select(order.alias("_order"))
        lowest = highest_with(tied, "_order", drawn - fit.filter(F.col("score") > last).count())
        within = (F.col("n_words") >= min_words) & ((F.col("score") > last) | ((F.col("score") == last) & (order >= lowest)))
        ranked = ranked.filter(~within).unionByName(_ranks(scored.filter(within), drawn))
    return ranked.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "n_features", "weight", "score", "rank")


def _ranks(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with their ``rank`` by falling score and rising id; those past ``most`` (repeats of the last one) have none."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // PARTITION_ROWS))
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]  # the row number parts equal rows
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))  # partition and place within it
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).toPandas().sort_values("part")  # one row per partition
    before = from_pandas(spark, pd.DataFrame({"_part": sizes["part"].astype("int64"), "_before": (sizes["n"].cumsum() - sizes["n"]).astype("int64")}), "_part long, _before long")
    joined = placed.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_part"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.withColumn("rank", F.when(rank <= most, rank)).drop("_at", "_part", "_before")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = f"""WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
        list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    w AS MATERIALIZED (SELECT doc_id AS id, false AS wanted, {_WORDS} AS words FROM documents UNION ALL SELECT item_id, true, {_WORDS} FROM benchmark),
    f AS MATERIALIZED (SELECT id, wanted, array_to_string(words[i:i + n - 1], ' ') AS g, count(*) AS c
        FROM (SELECT id, wanted, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(n)) GROUP BY 1, 2, 3),
    bytes AS (SELECT g, list_transform(range(strlen(g)), lambda k: CAST('0x' || substr(hex(encode(g)), 2 * k + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT g FROM f)),
    h AS MATERIALIZED (SELECT g, xor(list_reduce([4294967295] || b, lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
    per AS MATERIALIZED (SELECT bucket, coalesce(sum(c) FILTER (NOT wanted), 0) AS s, coalesce(sum(c) FILTER (wanted), 0) AS t FROM f JOIN h USING (g) GROUP BY 1),
    gain AS (SELECT bucket, CAST(floor({SCALE} * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM per),
    sums AS (SELECT id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM f JOIN h USING (g) JOIN gain USING (bucket) WHERE NOT wanted GROUP BY 1),
    noise AS (SELECT doc_id, (CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM documents),
    scored AS MATERIALIZED (SELECT id AS doc_id, len(words) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln(u))) AS BIGINT) AS score
        FROM w LEFT JOIN sums USING (id) JOIN noise ON noise.doc_id = w.id WHERE NOT wanted),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= {MIN_WORDS})
    SELECT s.doc_id, s.n_features, s.weight, s.score, r.rank FROM scored s
    LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * {PERCENT} // 100 FROM ranked)) r USING (doc_id)"""
