"""Meetings of rows that ask with rows that are stored, in tiles of bounded size.

Stored rows lie in cells, cells next to each other make a region, and rows that ask are dealt to chunks by the cell they lie in.
A row goes once to each region that holds a cell it has to visit, however many of its cells those are, and a region once to each chunk that
visits it. As a region and a chunk hold as many rows as a task may, what is moved for n rows of which all visit all is n * n over that number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.session import written

# Bytes of vectors on either side of a tile.
TILE_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Groups:
    """Cells packed in their order: the first group of each cell and how many it fills, one unless it is larger than a group."""

    first: np.ndarray
    parts: np.ndarray
    n: int

    def of(self, cell: Column, key: Column) -> Column:
        """The group of a row; the rows of a cell that fills several are dealt by a hash of their key."""
        return (_looked_up(self.first, cell) + F.pmod(F.xxhash64(key), _looked_up(self.parts, cell))).cast("int")

    def hit(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each row of a matrix that marks cells the groups that hold one of them."""
        of = np.repeat(np.arange(len(self.first)), self.parts)
        group = np.repeat(self.first, self.parts) + np.arange(len(of)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        found = np.logical_or.reduceat(cells[:, of], np.searchsorted(group, np.arange(self.n)), axis=1)
        return [np.flatnonzero(row).astype(np.int32) for row in found]


def _looked_up(values: np.ndarray, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), place + 1)


def packed(count: np.ndarray, rows: int) -> Groups:
    """Neighbouring cells with up to ``rows`` rows together; a larger cell makes several groups of its own."""
    first, parts, group, held = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0, 0
    for cell, n in enumerate(int(x) for x in count):
        if n > rows or held + n > rows:
            group, held = group + (cell > 0), 0
        first[cell] = group
        if n > rows:
            parts[cell] = -(-n // rows)
            group, held = group + int(parts[cell]) - 1, rows
        else:
            held += n
    return Groups(first, parts, group + 1 if len(count) else 0)


def tile_rows(width: int, least: int = 1) -> int:
    """Rows of a region or a chunk of vectors."""
    return max(least, TILE_BYTES // (8 * max(width, 1)))


def meet(asking: DataFrame, stored: DataFrame, key: str, cells: int, rows: int, answer: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kind: str) -> DataFrame:
    """What ``answer`` makes of the rows that ask and those stored, tile by tile.

    ``asking`` has the cell it lies in (_home) and the regions it visits (_regions), ``stored`` its region (_region). The driver holds
    one count per cell, and the list of tiles.
    """
    asking = written(asking)
    homes = asking.groupBy("_home").agg(F.count("*").alias("n")).toPandas()  # a row per cell
    count = np.zeros(cells, np.int64)
    count[homes["_home"]] = homes["n"]
    visits = asking.withColumn("_chunk", packed(count, rows).of(F.col("_home"), F.col(key))).withColumn("_region", F.explode("_regions")).drop("_regions")
    tiles = written(visits.select("_chunk", "_region").distinct())
    sent = stored.join(F.broadcast(tiles), "_region")
    tile = ["_chunk", "_region"]
    return visits.groupBy(*tile).cogroup(sent.groupBy(*tile)).applyInPandas(answer, kind)
