"""Pairs inside groups, by tiles: a group larger than a block is cut into blocks and each pair of
blocks is one unit of work, so that neither a group nor its pairs ever meet in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def into_tiles(rows: DataFrame, blocks: Column, mix: Column) -> DataFrame:
    """rows with _block, and once for each tile (_t1 <= _t2) of the row's group that it belongs to.

    blocks: how many blocks the row's group has; mix: a hash that deals rows to blocks.
    """
    placed = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_block", F.pmod(mix, F.col("_blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return placed.select("*", other).select(
        *placed.columns, F.least("_block", "_other").alias("_t1"), F.greatest("_block", "_other").alias("_t2")
    ).drop("_blocks")


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by keys; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        change = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        for a, b in zip(change, change[1:], strict=False):
            if held and rows[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = rows[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(mask_of: Callable[[np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose adjacency rows mask_of(nodes) gives.

    Breadth first; each node's row is asked for once, and only against what isn't reached yet.
    """
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    while left.any():
        front = np.flatnonzero(left)[:1]
        left[front] = False
        while len(front):
            rows = mask_of(front) & left
            hit = np.flatnonzero(rows.any(axis=0))
            out += [(int(front[rows[:, h].argmax()]), int(h)) for h in hit]
            left[hit] = False
            front = hit
            if not left.any():
                break
    return out
