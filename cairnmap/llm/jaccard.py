"""N-gram Jaccard join with a count-vector R-tree: components of texts that share most of their shingles.

1. One pass gives every text's set size and a 128-bit digest of its set; equal sets are one class, and only
   a class's first text goes on, so exact copies cost nothing more.
2. Two sets of similarity t share one of the first n - ceil(t * n) + 1 members under any common order of all
   shingles. The order is by how many texts have a shingle (rarest first, ties by hash), so passages
   that many texts share come last. To count, tasks send the sorted hashes of some millions of shingles at a time to ranges of
   hashes, as differences, with the texts' numbers; only shingles of several texts come back. A text with enough shingles of its own is
   near no other. Texts that share a prefix member form neighbourhoods.
   A neighbourhood larger than a block is connected anew by the shingles that are rarest within it, counted exactly.
3. A neighbourhood is cut into blocks of bounded bytes. In a block the sets' members are hashed into groups; the
   group counts are points of an R-tree whose boxes carry the largest count per group. The sum of the
   smaller coordinates bounds the overlap of a text with all texts in a box; what survives is verified on
   the sets themselves. Texts already known to be linked are not compared again, so a block returns a
   spanning forest, never all pairs. Blocks are first joined within themselves and then pairwise, only between texts
   whose components still differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairnmap.functions.graph import connected_components, roots
from cairnmap.functions.ranking import rank_rows
from cairnmap.llm.bytetext import ASCII_SPACE, CHUNK_BYTES, LOWER, distinct_sets, mix, over_texts, shingles, split_words, text_chunks
from cairnmap.session import written

WIDTH, PERCENT = 5, 75
# Shingles that are counted in one task, and that a task holds before it sends them; bits of a shingle's hash at most, and the largest count told apart.
SHARD_SHINGLES, FLUSH_SHINGLES, CELL_BITS, MOST_OFTEN = 1 << 22, 1 << 22, 48, (1 << 15) - 1
# Hash groups of a count vector: half the mean set size of a block, within these limits.
GROUPS = (64, 4_096)
# Shingles in a block: what one task holds at a time.
BLOCK_SHINGLES = 1 << 21
LEAF, FAN_OUT = 16, 16


def text_sets(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and where each text's start (one entry more than texts)."""
    words = split_words(texts, ASCII_SPACE, LOWER)
    hashes, owner = shingles(words, width)
    return distinct_sets(hashes, owner, len(texts))


def many_sets(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``text_sets`` of a block, a bounded number of bytes at a time."""
    part = np.cumsum([len(t or b"") for t in texts]) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
    found = [text_sets(texts[a:b], width) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([m for m, _ in found]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in found]))])


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """Smallest overlap o with 100 * o >= percent * (a + b - o)."""
    return -((-percent * (a + b)) // (100 + percent))


class RTree:
    """Boxes over count vectors, built bottom up from points in the order of size and leading groups."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*(counts[:, g] for g in range(3, -1, -1)), sizes))
        self.levels = [(counts[self.order], sizes[self.order])]
        span = LEAF
        while len(self.levels[-1][1]) > FAN_OUT:
            high, low = self.levels[-1]
            cuts = np.arange(0, len(low), span)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)))
            span = FAN_OUT

    def search(self, counts: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Points whose bound on the overlap with the given set reaches what its similarity needs."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            bound = np.minimum(high[at], counts).sum(axis=1, dtype=np.int64)
            # a box's smallest size asks for the least; so do partners below percent of the set's own size
            smallest = np.maximum(low[at], -(-percent * size // 100)) if depth else low[at]
            at = at[bound >= least_overlap(size, smallest, percent)]
            if depth:
                span = LEAF if depth == 1 else FAN_OUT
                at = (at[:, None] * span + np.arange(span)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def group_counts(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    groups = int(np.clip(len(members) // (2 * max(1, len(first) - 1)), *GROUPS))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = owner * groups + ((members >> np.uint64(32)).astype(np.int64) * groups >> 32)
    return np.bincount(flat, minlength=(len(first) - 1) * groups).reshape(-1, groups).astype(np.int32)


def forest(texts: list[bytes], parts: np.ndarray, known: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (by position) that join the texts' components as all their links would.

    ``known`` are component labels the texts have already. With two values in ``parts`` only texts of
    different parts are compared.
    """
    members, first = many_sets(texts, width)
    sizes = np.diff(first)
    parent = np.arange(len(texts))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in enumerate(np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]):
        parent[root(i)] = root(int(j))
    counts, links = group_counts(members, first), []
    split = len(np.unique(parts)) > 1
    inside = np.flatnonzero((parts == parts.max()) if split else np.ones(len(texts), bool))
    if not len(inside):
        return links
    tree = RTree(counts[inside], sizes[inside])
    queries = np.flatnonzero(parts != parts.max()) if split else np.arange(len(texts))
    for q in queries:
        own, mine = root(q), members[first[q]:first[q + 1]]
        found = inside[tree.search(counts[q], int(sizes[q]), percent)]
        if not split:
            found = found[found > q]
        for p in found:
            other = root(p)
            if other == own or not sizes[p]:
                continue
            theirs = members[first[p]:first[p + 1]]
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            overlap = int((theirs[at] == mine).sum())
            if 100 * overlap >= percent * (len(mine) + len(theirs) - overlap):
                parent[other] = own
                links.append((int(q), int(p)))
    return links


_SETS = "n_words long, n_shingles long, digest_a long, digest_b long"


def _digests(width: int):
    """Each row's words, set size and a 128-bit digest of its set, beside its other columns."""
    def fn(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        words = split_words(texts, ASCII_SPACE, LOWER)
        members, first = distinct_sets(*shingles(words, width), len(texts))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members + np.uint64(salt)))]) for salt in (17, 91)]
        kept = [(c, f.name) for c, f in zip(piece.columns, piece.schema) if f.name != "text"]
        added = [pa.array(words.counts, pa.int64()), pa.array(np.diff(first), pa.int64()), *[pa.array((x[first[1:]] - x[first[:-1]]).astype(np.int64)) for x in sums]]
        return pa.RecordBatch.from_arrays([*[c for c, _ in kept], *added], names=[*[n for _, n in kept], *[x.split()[0] for x in _SETS.split(", ")]])

    return over_texts(fn)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of bytes; bytes that are all zero cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _dealt_cells(shards: int, bits: int, width: int):
    """Rows (id, text) as one row per shard and some millions of shingles: sorted cells, as differences, and the id of each.

    A cell is the first ``bits`` bits of a shingle's hash, and a shard a range of cells, so differences are small numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ids = [], []

        def flushed() -> pa.RecordBatch:
            cell, who = np.concatenate(cells), np.concatenate(ids)
            order = np.argsort(cell)
            cell, who = cell[order], who[order]
            shard = (cell >> np.uint64(bits - 31)).astype(np.int64) * shards >> 31
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            ends = np.append(first[1:], len(cell))
            rows = [(int(shard[i]), j - i, int(cell[i]), _squeezed(np.diff(cell[i:j], prepend=cell[i])), _squeezed(who[i:j])) for i, j in zip(first.tolist(), ends.tolist())]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "n", "low", "cells", "ids"])

        for piece, texts in text_chunks(batches):
            numbers = piece.column(piece.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            members, first = text_sets(texts, width)
            cells.append(members >> np.uint64(64 - bits))
            ids.append(np.repeat(numbers.astype(np.uint64), np.diff(first)))
            if sum(map(len, cells)) >= FLUSH_SHINGLES:
                yield flushed()
                cells, ids = [], []
        if sum(map(len, cells)):
            yield flushed()

    return run


def _shared_members(bits: int):
    """A shard's cells that several ids have: (id, member); members sort by how many ids have them, then by cell."""
    def run(group: pa.Table) -> pa.Table:
        cells, ids = [], []
        for row in group.to_pylist():
            cells.append(np.cumsum(_unsqueezed(row["cells"], row["n"])) + np.uint64(row["low"]))
            ids.append(_unsqueezed(row["ids"], row["n"]))
        cell, who = np.concatenate(cells), np.concatenate(ids)
        order = np.argsort(cell, kind="stable")  # a merge of sorted runs
        cell, who = cell[order], who[order]
        again = np.zeros(len(cell) + 1, bool)
        again[1:-1] = cell[1:] == cell[:-1]
        several = again[1:] | again[:-1]
        cell, who = cell[several], who[several]
        order = np.lexsort((who, cell))
        cell, who = cell[order], who[order]
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (who[1:] != who[:-1])
        cell, who = cell[fresh], who[fresh]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[:len(cell)])
        times = np.diff(np.append(first, len(cell)))
        often = np.repeat(times, times)
        kept = often > 1
        member = (np.minimum(often[kept], MOST_OFTEN).astype(np.int64) << bits) | cell[kept].astype(np.int64)
        return pa.table({"id": pa.array(who[kept].astype(np.int64)), "member": pa.array(member)})

    return run


def rare_members(texts: DataFrame, sizes: DataFrame, shingles_: int, width: int, percent: int, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """(id, n_shingles, tokens): of each text's prefix, the members that other texts have as well; texts without any are left out.

    ``texts`` has id and text, ``sizes`` id and n_shingles. Members are counted over all texts, and ordered by that count. A member of one
    text alone comes first in the order and joins nothing, so it only shortens what is left of the prefix.
    """
    shards = max(1, -(-shingles_ // shard_shingles))
    bits = min(CELL_BITS, max(32, shingles_.bit_length() + 7))
    dealt = texts.mapInArrow(_dealt_cells(shards, bits, width), "shard int, n long, low long, cells binary, ids binary")
    shared = dealt.groupBy("shard").applyInArrow(_shared_members(bits), "id long, member long")
    lists = shared.groupBy("id").agg(F.collect_list("member").alias("members"))  # at most a text's own set
    n = F.col("n_shingles")
    left = n + F.floor(F.lit(-percent) * n / 100).cast("long") + 1 - (n - F.size("members"))
    return lists.join(sizes, "id").filter(left > 0).select("id", "n_shingles", F.slice(F.array_sort("members"), F.lit(1), left.cast("int")).alias("tokens"))


def _all_shingles(width: int):
    """Rows of id, place and text as one row per member of the text's set; ``row`` is the set's size and 32 bits of its digest."""
    def fn(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        members, first = text_sets(texts, width)
        sums, sizes = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members))]), np.diff(first)
        row = sizes.astype(np.int64) << 32 | ((sums[first[1:]] - sums[first[:-1]]) >> np.uint64(32)).astype(np.int64)
        owner = pa.array(np.repeat(np.arange(len(texts)), sizes))
        kept = [piece.column(piece.schema.get_field_index(c)).take(owner) for c in ("id", "place")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(row).take(owner), pa.array(members.view(np.int64))], names=["id", "place", "row", "token"])

    return over_texts(fn)


def _unit_links(width: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, links = group.drop_duplicates("id"), []
        if group["known"].nunique() > 1:
            group = group.sort_values(["part", "id"], kind="stable")
            links = forest(group["text"].tolist(), group["part"].to_numpy(), group["known"].to_numpy(), width, percent)
        ids = group["id"].to_numpy(np.int64)
        ends = np.array(links, np.int64).reshape(-1, 2)
        nodes, root = roots(ids[ends[:, 0]], ids[ends[:, 1]])
        return pd.DataFrame({"a": nodes, "b": root})  # the links' components as stars

    return run


def _band_array(percent: int):
    """A set's two size bands: sets whose sizes allow the similarity have one in common."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("long")
    return F.array(band, band + 1)


def neighbourhoods(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, place): texts of a size band that are connected through shared prefix members share a ``place``.

    ``rows`` has id, n_shingles and tokens. Counts and leaders per token are partial sums, and a frequent
    token's rows meet them in ordinary, splittable joins.
    """
    flat = rows.select("id", "n_shingles", F.explode("tokens").alias("token"))
    shared = flat.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    several = written(flat.join(shared, "token"))
    # tokens held by the same texts say the same: one of them is kept
    alike = several.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_ids"))
    kept = alike.groupBy("n", "_lo", "_hi", "_ids").agg(F.min("token").alias("token")).select("token")
    banded = written(several.join(kept, "token")).withColumn("band", F.explode(_band_array(percent)))
    return _connected(banded)


def _connected(banded: DataFrame) -> DataFrame:
    """(id, n_shingles, place): the texts of a ``band`` that shared tokens connect; ``banded`` has id, n_shingles, token and band."""
    leads = banded.groupBy("token", "band").agg(F.min("id").alias("lead"), F.max("id").alias("_last")).filter("lead < _last")
    node = lambda i: F.xxhash64("band", i)  # noqa: E731  equal hashes would only merge neighbourhoods
    stars = written(banded.join(leads, ["token", "band"]).select("id", "n_shingles", node("id").alias("node"), node("lead").alias("hub")).distinct())
    found = connected_components(stars, "node", "hub")
    return stars.select("node", "id", "n_shingles").distinct().join(found, "node").select("id", "n_shingles", F.col("component").alias("place"))


def refined(members: DataFrame, named: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Neighbourhoods connected anew by the shingles that are rarest within each of them, as exact counts say.

    The sketch has a fixed size, so it cannot tell a single text's shingles from those of a few texts once the input is
    large; here all shingles of the given neighbourhoods are counted. A text with enough shingles of its own leaves.
    """
    texts = members.select("id", "place").distinct().join(named, "id").select("id", "place", "text")
    flat = texts.mapInArrow(_all_shingles(width), "id long, place long, row long, token long")
    flat = flat.select("id", "place", "row", F.xxhash64("place", "token").alias("token"))
    counts = flat.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    one = Window.partitionBy("place", "id", "row")
    size = F.shiftright("row", 32)
    # equal rows hold each shingle several times, so ranks count distinct ones
    ranked = flat.join(counts, "token").withColumn("_rank", F.dense_rank().over(one.orderBy("n", "token")))
    own = size - F.max("_rank").over(one)
    ranked = ranked.withColumn("_most", size - F.expr(f"({percent} * shiftright(row, 32) + 99) div 100") + 1 - own)
    prefix = ranked.filter("_rank <= _most").select("id", size.alias("n_shingles"), "token", F.col("place").alias("band"))
    return _connected(written(prefix.distinct()))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                       block_shingles: int = BLOCK_SHINGLES, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links.

    Two texts link when 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word shingles (a text of
    fewer words is one shingle). A null text and one without words have an empty set and link to nothing, so they
    keep their own id. Rows that repeat a doc_id are linked by that id; a null doc_id gets its text's component,
    or null if no row with an id has the same set. Very long texts are sets like any other; a block holds at least
    one text. An empty table gives an empty table; other columns are ignored.
    """
    return components_with(docs, (), doc_id, text, width, percent, block_shingles, shard_shingles).select("doc_id", "n_shingles", "component_id")


def components_with(docs: DataFrame, keep: Sequence[str], doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    block_shingles: int = BLOCK_SHINGLES, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """``jaccard_components`` with each row's ``n_words`` and its columns ``keep`` as ``kept_0``, ``kept_1``, ..."""
    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").cast("binary").alias("text"))
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), *kept, F.col(f"`{text}`").cast("binary").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    sets = written(slim.mapInArrow(_digests(width), f"{kinds}, {_SETS}"))
    key = ["n_shingles", "digest_a", "digest_b"]
    # a class's first text by id; classes are numbered in that order
    held = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("f"))
    classes = written(rank_rows(held.select(*key, "f.*"), [F.col(c) for c in ("doc_id", *key)], "id"))
    # texts meet a narrow row of their class, hashed, so that they need no sort
    firsts = classes.select("doc_id", "text_hash", "id").hint("shuffle_hash")
    total_shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0

    tokens = rare_members(base.join(firsts, ["doc_id", "text_hash"]).select("id", "text"), classes.select("id", "n_shingles"), total_shingles, width, percent, shard_shingles)
    members = written(neighbourhoods(written(tokens), percent))
    asked = members.select("id").distinct().join(classes.select("doc_id", "text_hash", "id"), "id").hint("shuffle_hash")
    named = written(base.join(asked, ["doc_id", "text_hash"]).select("id", "text"))
    small, before = F.col("_w") <= block_shingles, None
    while True:
        places = members.groupBy("place").agg(F.sum("n_shingles").alias("_w"))
        total = places.agg(F.sum(F.when(small, F.col("_w"))).alias("w"), F.sum(F.when(~small, F.col("_w"))).alias("large")).first()
        if not total["large"] or before and 4 * total["large"] > 3 * before:
            break
        before, large = total["large"], places.filter(~small).select("place")
        members = written(members.join(large, "place", "left_anti").select("id", "n_shingles", "place").union(
            refined(members.join(large, "place", "left_semi"), named, width, percent)))
    units = max(1, -(-(total["w"] or 0) // block_shingles))
    placed = members.join(places, "place").withColumn("blocks", F.when(small, 1).otherwise(F.ceil(F.col("_w") / block_shingles)).cast("int"))
    unit = F.when(small, F.pmod(F.col("place"), F.lit(units))).otherwise(F.col("place"))
    placed = placed.select("id", unit.alias("unit"), "blocks", F.when(small, -1).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"))
    placed = written(placed.distinct())
    first_round = placed.join(named, "id").select("id", "unit", "block", "text", F.col("id").alias("known"), F.lit(0).alias("part"))
    links = written(first_round.groupBy("unit", "block").applyInPandas(_unit_links(width, percent), "a long, b long"))
    if total["large"]:
        labels = connected_components(links, "a", "b")
        cut = placed.filter("block >= 0").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
        cut = cut.withColumn("known", F.coalesce("component", "id")).drop("component")
        open_ = cut.groupBy("unit").agg(F.min("known").alias("_a"), F.max("known").alias("_b")).filter("_a < _b").select("unit")
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))
        pairs = cut.join(open_, "unit").withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        second = pairs.join(named, "id").select("id", "unit", "low", "high", "text", "known", (F.col("block") != F.col("low")).cast("int").alias("part"))
        links = links.union(second.groupBy("unit", "low", "high").applyInPandas(_unit_links(width, percent), "a long, b long"))
    placed_sets = sets.join(classes.select(*key, "id"), key, "left")
    # rows that repeat a doc_id link the classes of their texts
    leads = placed_sets.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_last")).filter("a < _last").select("doc_id", "a")
    repeated = leads.join(placed_sets.select("doc_id", F.col("id").alias("b")), "doc_id").filter("a <> b").select("a", "b").distinct()
    joined = connected_components(links.union(repeated), "a", "b")
    named_ids = classes.select("id", "doc_id")
    moved = joined.join(named_ids.withColumnRenamed("id", "component"), "component").select(F.col("node").alias("id"), F.col("doc_id").alias("_c"))
    own = classes.select(*key, "id", F.col("doc_id").alias("_own")).join(moved, "id", "left").select(*key, F.coalesce("_c", "_own").alias("_c"))
    names = [f"kept_{i}" for i in range(len(keep))]
    return sets.join(own, key, "left").select("doc_id", *names, "n_words", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows of ``docs`` whose doc_id is its component's smallest, with ``docs``' columns; one text of each component stays.

    Of rows that repeat a doc_id, and of rows without one, every row stays whose id is (null-safely) the component's.
    """
    kept = jaccard_components(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_kept"]), "left_semi")


ORACLE = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + {WIDTH} - 1], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WIDTH} + 1, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
        JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * o >= {PERCENT} * (na.n + nb.n - o)),
    reach(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id AND r.c < l.b)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2"""
