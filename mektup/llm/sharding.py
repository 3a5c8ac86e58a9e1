"""Documents dealt to shards of near-equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mektup.llm.common import partitions, texts
from mektup.session import written

#: Bytes that each document takes besides its text.
OVERHEAD = 8
#: Groups that a task differences at once; further ones make partial partitions of their own.
CHUNK = 100_000


def difference(loads: list[list[float]], shards: int) -> list[list[int]]:
    """Combine partial partitions until one is left; for each, the shard of each of its parts.

    ``loads`` holds a list of at most ``shards`` part sums per partial partition (a single group
    is one part). The two with the largest spread, that is the largest less the smallest sum, are
    combined again and again, the larger parts of one with the smaller of the other. Sums are
    kept in descending order with trailing zeros left out; equal spreads go by position.
    """
    if not loads:
        return []
    sums = [sorted(x, reverse=True) for x in loads]
    parts: list[list[tuple[int, int] | int]] = [
        [(i, j) for j in sorted(range(len(x)), key=lambda j: (-x[j], j))] for i, x in enumerate(loads)
    ]

    def spread(values: list[float]) -> float:
        return (values[0] if values else 0) - (values[-1] if len(values) == shards else 0)

    # Chains: a part of a combined partition is a linked list of original parts.
    chains: list[tuple] = []
    heap = [(-spread(x), i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        over = max(0, len(sums[a]) + len(sums[b]) - shards)
        keep_a, keep_b = len(sums[a]) - over, len(sums[b]) - over
        joined = [(s, p) for s, p in zip(sums[a][:keep_a], parts[a][:keep_a])]
        joined += [(s, p) for s, p in zip(sums[b][:keep_b], parts[b][:keep_b])]
        for k in range(over):  # opposite order: the largest of these with the smallest of those
            i, j = keep_a + k, len(sums[b]) - 1 - k
            chains.append((parts[a][i], parts[b][j]))
            joined.append((sums[a][i] + sums[b][j], len(chains) - 1))
        joined.sort(key=lambda x: -x[0])
        sums[a], parts[a] = [x[0] for x in joined], [x[1] for x in joined]
        sums[b], parts[b] = [], []
        heapq.heappush(heap, (-spread(sums[a]), a))
    result = [[0] * len(x) for x in loads]
    for shard, top in enumerate(parts[heap[0][1]]):
        stack = [top]
        while stack:
            part = stack.pop()
            if isinstance(part, tuple):
                result[part[0]][part[1]] = shard
            else:
                stack.extend(chains[part])
    return result


def _differ_locally(shards: int, chunk: int = CHUNK):
    def placed(frames: list[pd.DataFrame], number: int) -> pd.DataFrame:
        groups = pd.concat(frames, ignore_index=True)
        order = np.lexsort((groups["key"].to_numpy(), -groups["bytes"].to_numpy()))
        groups = groups.iloc[order]
        found = difference([[float(x)] for x in groups["bytes"]], shards)
        part = (TaskContext.get().partitionId() << 32) + number
        return groups.assign(part=np.int64(part), subset=np.array([x[0] for x in found], dtype=np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames: list[pd.DataFrame] = []
        number = 0
        for batch in batches:
            for at in range(0, len(batch), chunk):
                frames.append(batch.iloc[at : at + chunk])
                if sum(map(len, frames)) >= chunk:
                    yield placed(frames, number)
                    frames, number = [], number + 1
        if frames:
            yield placed(frames, number)

    return run


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard, bytes are near equal.

    Differencing runs in two levels. Each partition of the groups (whose copies are summed before
    the shuffle) differences its own groups, up to `CHUNK` at once, into partial partitions of
    ``shards`` parts; the driver then differences these, ``shards`` sums for so many groups, and
    the outcome goes back as a table of that size. A group larger than a shard's share stays whole.
    Slots count from 0 in each shard. Null texts count as empty (size 8) and as equal; ids may be
    null or repeat, each row has its own slot. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(
        texts(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    local = written(
        groups.mapInPandas(_differ_locally(shards), "key binary, bytes long, part long, subset int"), "shard-groups"
    )
    sums: dict[int, dict[int, int]] = {}
    for part, subset, total in local.groupBy("part", "subset").agg(F.sum("bytes")).collect():
        sums.setdefault(part, {})[subset] = total
    order = sorted(sums)
    placed = difference([[float(sums[p][s]) for s in sorted(sums[p])] for p in order], shards)
    where = [
        (int(p), int(s), int(shard)) for p, found in zip(order, placed) for s, shard in zip(sorted(sums[p]), found)
    ]
    where_table = spark.createDataFrame(where, "part long, subset int, shard int")
    to = local.join(F.broadcast(where_table), ["part", "subset"]).select("key", "shard")
    buckets = partitions(spark)
    dealt = written(
        rows.join(to, "key").select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
        ),
        "shard-dealt",
    )
    # Slots: rows of a shard are counted by bucket, and each bucket numbers its own rows.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return (
        dealt.withColumn("number", number)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).alias("slot"))
    )
