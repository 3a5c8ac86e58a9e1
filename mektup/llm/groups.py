"""Sorted Arrow batches as groups, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.session import written


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns (none null), across batch borders."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for begin, end in zip(starts[:-1], starts[1:]):
            key = tuple(batch.column(k)[begin].as_py() for k in range(keys))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Sets of the numbers 0 to n - 1 that are joined bit by bit."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); the root is the least node of its component.

    Large-star and small-star steps alternate: each moves every edge to the least neighbour, so
    the number of edges never grows and a component becomes a star in a logarithmic number of
    rounds. Each round is written to the shared folder, which cuts the lineage. Hot nodes are
    aggregated before the shuffle, and the joins can be split by the adaptive planner.
    """
    star = written(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "star",
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = star.agg(mark).first()[0]
    while seen[0]:
        near = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        now = star.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
