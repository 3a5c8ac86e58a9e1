"""Ranked lexical search by bit-sliced Bloom signatures: bitmaps bound the scores, what they cannot exclude is scored exactly."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mektup.llm.common import partitions, texts

HITS = "item int, doc_id long, score long"

#: Bytes of a term stand for themselves, A-Z for a-z, all other ASCII for a blank.
_PLAIN = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


@dataclass(frozen=True)
class Signatures:
    """How documents are signed and how many of them a search returns."""

    top: int = 10
    #: Documents of a block; each slice holds one bit for each of them.
    rows: int = 4096
    #: Bytes of text that a block may hold, so that a few very long documents make a block of their own.
    block_bytes: int = 8_000_000
    #: Slices a term sets, and slices for each distinct term of the block's richest document.
    hashes: int = 2
    slices_per_term: int = 8
    #: A term is signed again at each of these counts, which bounds how often a document holds it.
    counts: tuple[int, ...] = (1, 2, 4, 8)
    #: Characters of items that one broadcast may hold; a larger query set is searched in several passes.
    item_chars: int = 8_000_000


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, of which only A-Z are lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def idf(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def damping(length: int, documents: int, total: int) -> int:
    return 100 - 75 + (75 * length * documents) // total


def saturated(count, damped):
    """What ``count`` occurrences are worth; grows with the count. Takes numbers or integer arrays."""
    return (1_000_000_000 * count) // (1000 * count + 8 * damped)


@dataclass
class Queries:
    """The items of a pass: of each item its known terms with their weights (repeats included)."""

    vocabulary: dict[bytes, int]
    weights: list[tuple[np.ndarray, np.ndarray]]  # term numbers and weights of each item
    documents: int
    total: int


class Block:
    """The signatures of some documents: slice by slice a bitmap over the documents."""

    def __init__(self, counted: list[Counter], s: Signatures):
        self.s = s
        richest = max((len(c) for c in counted), default=1)
        self.bits = max(6, int(richest * s.slices_per_term - 1).bit_length())
        self.rows = len(counted)
        width = (self.rows + 7) // 8 * 8
        flat = np.zeros((1 << self.bits, width), dtype=bool)
        for level, least in enumerate(s.counts):
            hashes, owners = [], []
            for row, counts in enumerate(counted):
                found = counts if least == 1 else [t for t, n in counts.items() if n >= least]
                hashes.extend(map(zlib.crc32, found))
                owners.append(len(found))
            owner = np.repeat(np.arange(self.rows), owners)
            for at in self._slices(np.array(hashes, dtype=np.uint64), level):
                flat[at, owner] = True
        self.bitmaps = np.packbits(flat, axis=1)

    def _slices(self, crc: np.ndarray, level: int) -> Iterator[np.ndarray]:
        for k in range(self.s.hashes):
            h = (crc + np.uint64(1 + level * self.s.hashes + k)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def present(self, crc: np.ndarray) -> list[np.ndarray]:
        """For each count a table [terms, documents] that is true wherever a document may hold a term so often."""
        found, before = [], None
        for level in range(len(self.s.counts)):
            bitmaps = None
            for at in self._slices(crc, level):
                bitmaps = self.bitmaps[at] if bitmaps is None else bitmaps & self.bitmaps[at]
            before = bitmaps if before is None else before & bitmaps
            found.append(np.unpackbits(before, axis=1, count=self.rows).astype(bool))
        return found


def _gains(lengths: np.ndarray, damped: np.ndarray, s: Signatures) -> list[np.ndarray]:
    """What a term adds to a document's bound when it also passes the next count; the sums bound `saturated`."""
    ends = [np.minimum(n - 1, np.maximum(lengths, 1)) for n in s.counts[1:]] + [np.maximum(lengths, 1)]
    values = [saturated(e, damped) for e in ends]
    return [values[0], *(b - a for a, b in zip(values[:-1], values[1:]))]


class Search:
    """The best documents so far of every item, over the blocks of a task."""

    def __init__(self, queries: Queries, s: Signatures):
        self.queries, self.s = queries, s
        self.names = list(queries.vocabulary)
        self.crc = np.array([zlib.crc32(t) for t in self.names], dtype=np.uint64)
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in queries.weights]

    def add(self, ids: list, counted: list[Counter]) -> None:
        q, s = self.queries, self.s
        lengths = np.array([c.total() for c in counted], dtype=np.int64)
        damped = 25 + (75 * lengths * q.documents) // q.total
        block = Block(counted, s)
        present = block.present(self.crc)
        somewhere = present[0].any(axis=1)
        gains = [g.astype(np.float64) for g in _gains(lengths, damped, s)]
        for item, (numbers, weights) in enumerate(q.weights):
            used = somewhere[numbers]
            numbers, weights = numbers[used], weights[used]
            if not len(numbers):
                continue
            bound = np.zeros(block.rows)
            for table, gain in zip(present, gains):
                bound += (weights @ table[numbers]) * gain
            self._rescore(item, bound, ids, counted, damped)

    def _rescore(self, item: int, bound: np.ndarray, ids: list, counted: list[Counter], damped: np.ndarray) -> None:
        """Score documents by falling bound until the next bound lies below the worst kept score."""
        best, top = self.best[item], self.s.top
        floor = best[-1][0] if len(best) == top else 1
        rows = np.flatnonzero(bound >= floor)
        numbers, weights = self.queries.weights[item]
        wanted = [(self.names[n], int(w)) for n, w in zip(numbers.tolist(), weights.tolist())]
        for row in rows[np.argsort(-bound[rows], kind="stable")].tolist():
            if bound[row] < floor:
                break
            counts, m = counted[row], int(damped[row])
            score = sum(w * saturated(counts[t], m) for t, w in wanted if t in counts)
            if score >= floor:
                own = ids[row]
                best.append((score, math.inf if own is None else own, own))
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[top:]
                floor = best[-1][0] if len(best) == top else 1


def _statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, holding, documents, total = shared.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                documents += bool(found)
                total += len(found)
                holding.update(known.keys() & found)
        rows = [(-1, documents), (-2, total), *((known[t], n) for t, n in holding.items())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    about = {-1: 0, -2: 0}
    for term, n in sums.collect():
        if term < 0:
            about[term] = n
        else:
            holding[term] = n
    return about[-1], about[-2], holding


def _blocks(batches: Iterator[pa.RecordBatch], s: Signatures) -> Iterator[tuple[list, list[Counter]]]:
    """Documents with a term, in blocks; those of a block are of like length, so that one number of slices fits all."""
    ids: list = []
    held: list[Counter] = []
    size = 0

    def cut() -> Iterator[tuple[list, list[Counter]]]:
        order = sorted(range(len(held)), key=lambda k: len(held[k]))
        at = 0
        while at < len(order):
            most = max(64, 4 * len(held[order[at]]))
            end = at + 1
            while end < len(order) and len(held[order[end]]) <= most:
                end += 1
            yield [ids[k] for k in order[at:end]], [held[k] for k in order[at:end]]
            at = end

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Counter(terms(text))
            if not found:
                continue
            ids.append(own)
            held.append(found)
            size += len(text)
            if len(ids) >= s.rows or size >= s.block_bytes:
                yield from cut()
                ids, held, size = [], [], 0
    if held:
        yield from cut()


def search(docs: DataFrame, items: DataFrame, s: Signatures = Signatures(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``s.top`` best documents of every item.

    Terms are runs of letters, digits and non-ASCII characters. A term that df of N documents
    hold weighs floor(1000 ln((2N + 2) / (2df + 1))); occurrences saturate, and longer documents
    are damped, all in whole numbers. Equal scores rank by ascending doc_id, null ids last; rows
    that repeat an id or a text are documents of their own. Documents without a term (null and
    empty texts too) and scores of 0 are not ranked. An empty table on either side gives no rows.
    Rows of ``items`` that repeat are ranked each on its own. Other columns are not read.

    Items are a query set: their terms go to the tasks in passes of bounded size. Two passes over
    the documents count and search; nothing but the best ``s.top`` rows of each task and item is
    shuffled. In a task, a block of documents is signed as slices: bit k of a slice is set when
    document k has a term that hashes to it, once more for each count the term reaches there.
    The conjunction of a term's slices holds every document with the term, so sums of weights
    over these bitmaps bound all scores from above. Documents are scored exactly by falling
    bound until the next bound lies below the worst score kept.
    """
    narrow = texts(docs, id_col, text_col)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = 1 + chars // s.item_chars
    result = None
    for number in range(passes):
        held = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        found = _search_pass(narrow, [(r[0], r[1]) for r in held], s)
        result = found if result is None else result.unionByName(found)
    return result


def _search_pass(narrow: DataFrame, held: list[tuple[int | None, str]], s: Signatures) -> DataFrame:
    spark = narrow.sparkSession
    asked = [terms(text) for _, text in held]
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for found in asked for t in found))}
    documents, total, holding = _statistics(narrow, vocabulary)
    weights = []
    for found in asked:
        counts = Counter(found)
        numbers = np.array([vocabulary[t] for t in counts], dtype=np.int64)
        worth = np.array([n * idf(documents, int(holding[vocabulary[t]])) for t, n in counts.items()], dtype=np.float64)
        known = (worth > 0) & (holding[numbers] > 0) if len(numbers) else np.zeros(0, dtype=bool)
        weights.append((numbers[known], worth[known]))
    queries = spark.sparkContext.broadcast(Queries(vocabulary, weights, documents, max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Search(queries.value, s)
        for ids, counted in _blocks(batches, s):
            task.add(ids, counted)
        rows = [(item, own, score) for item, best in enumerate(task.best) for score, _, own in best]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["item", "doc_id", "score"])

    hits = narrow.mapInArrow(run, HITS)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # the best of each group of tasks first, so that no task ranks the rows of all tasks
    dealt = hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(partitions(spark))))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= s.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= s.top)
    names = spark.createDataFrame([(k, own) for k, (own, _) in enumerate(held)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
