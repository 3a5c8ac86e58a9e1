"""Repeated passages, byte by byte: a run-compressed Burrows-Wheeler index of what may repeat, and its matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import partitions, small_first
from mektup.session import written

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
FATES = "id long, place long, bytes int"
_LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Repeats:
    """What counts as a repeat and how the work is cut."""

    #: Bytes of a string that makes a repeat.
    length: int = 100
    #: Bytes of an anchor, level by level; strings of an anchor that too many passages share go on to the next.
    anchors: tuple[int, ...] = (24, 60, 100)
    #: Different passages around an anchor that go into one index.
    group: int = 4096
    #: Bytes of an index, and bytes of text cut into passages at once and told apart at once.
    index_bytes: int = 800_000
    cut_bytes: int = 500_000
    batch_bytes: int = 8_000_000


# --- passages around anchors -----------------------------------------------------------------


@cache
def _chances(size: int) -> tuple[np.ndarray, ...]:
    """For two polynomials the values of bytes, powers of the base, and powers of its inverse."""
    chance = np.random.default_rng(11)
    found = []
    for _ in range(2):
        values = chance.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(chance.integers(2**40, 2**59)) * 8 + 5
        for b in (base, pow(base, -1, 1 << 64)):
            powers = np.full(size, b, dtype=np.uint64)
            powers[0] = 1
            found.append(np.cumprod(powers, dtype=np.uint64))
        found.append(values)
    return tuple(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` adjacent values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Passages:
    """Runs of strings of one document that share their anchor: where they are, how many, and hashes."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    #: 48 bits of the anchor's hash, then 16 of the passage's; 56 further bits of the passage's, then 8 of the count.
    key: np.ndarray
    digest: np.ndarray


def passages(texts: list[bytes], anchor: int, length: int) -> Passages:
    """Cut texts into passages. A string of ``length`` bytes belongs to the anchor with the least hash in it.

    Equal strings have equal anchors at equal places, whatever stands around them, so a string
    can repeat only where its anchor repeats.
    """
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    t = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(t)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return Passages(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    up, down, values, up2, down2, values2 = _chances(max(1 << 20, 1 << int(n + 1).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[t] * up[:n], out=total[1:])
    grams = _mixed((total[anchor:] - total[:-anchor]) * down[: n + 1 - anchor])
    low = np.uint64((1 << 24) - 1)
    least = _least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
    at = (least & low).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.arange(len(at)) + length <= np.repeat(ends, sizes)[: len(at)]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    last = np.ones(len(at), dtype=bool)
    last[:-1] = new[1:] | ~inside[1:]
    first, last = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    count = last - first + 1
    stop = last + length
    total2 = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values2[t] * up2[:n], out=total2[1:])
    one = _mixed((total[stop] - total[first]) * down[first])
    two = _mixed((total2[stop] - total2[first]) * down2[first] + one)
    key = (grams[at[first]] & ~np.uint64(0xFFFF)) | (one & np.uint64(0xFFFF))
    digest = (two & ~np.uint64(0xFF)) | count.astype(np.uint64)
    doc = np.searchsorted(ends, first, "right")
    return Passages(doc, first - (ends - sizes)[doc], count, key, digest)


def _told_apart(ids: np.ndarray, places: np.ndarray, key: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first among those with equal passages, and the others; repeated rows are in neither."""
    order = np.lexsort((places, ids, digest, key))
    k, d, i, p = key[order], digest[order], ids[order], places[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(order), dtype=bool)
    again[1:] = same[1:] & (i[1:] == i[:-1]) & (p[1:] == p[:-1])
    return order[~same], order[same & ~again]


def _joined(ids: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching byte ranges of a document as one; places of a document differ only in their low half."""
    if not len(ids):
        return ids, places, sizes
    order = np.lexsort((places, ids))
    i, p, e = ids[order], places[order], places[order] + sizes[order]
    group = np.zeros(len(i), dtype=bool)
    group[1:] = (i[1:] != i[:-1]) | (p[1:] >> 32 != p[:-1] >> 32)
    number = np.cumsum(group)
    # ends so far within a document: shift documents apart, then one running maximum
    local = e - (p >> 32 << 32)
    so_far = np.maximum.accumulate(local + number * (1 << 33)) - number * (1 << 33)
    begins = np.ones(len(i), dtype=bool)
    begins[1:] = group[1:] | ((p[1:] & 0xFFFFFFFF) > so_far[:-1])
    first = np.flatnonzero(begins)
    final = np.append(first[1:] - 1, len(i) - 1)
    return i[first], p[first], so_far[final] - (p[first] & 0xFFFFFFFF)


CUT = "key long, digest long, id long, place long, bytes int, content binary"


def _cut_batch(columns: tuple[np.ndarray, np.ndarray, list[bytes]], anchor: int, r: Repeats, keep: bool) -> Iterator[pa.RecordBatch]:
    """The passages of some texts: the first of equal ones by their hashes; bytes that any other covers at once."""
    ids, places, texts = columns
    found: list[tuple[np.ndarray, ...]] = []
    contents: list[bytes] = []
    part: list[bytes] = []
    where: list[tuple[int, int]] = []  # text and first byte of each part

    def flush() -> None:
        if not part:
            return
        p = passages(part, anchor, r.length)
        own = np.array(where, dtype=np.int64).reshape(-1, 2)
        text, first = own[p.doc, 0], own[p.doc, 1] + p.start
        found.append((ids[text], places[text] + first, p.count, p.key.view(np.int64), p.digest.view(np.int64)))
        if keep:
            contents.extend(texts[x][f : f + c + r.length - 1] for x, f, c in zip(text.tolist(), first.tolist(), p.count.tolist()))
        part.clear()
        where.clear()

    size = 0
    for number, text in enumerate(texts):
        # a very long text is cut in overlapping parts, each string in one of them
        for begin in range(0, max(len(text) - r.length + 1, 0), r.cut_bytes):
            piece = text[begin : begin + r.cut_bytes + r.length - 1]
            part.append(piece)
            where.append((number, begin))
            size += len(piece)
            if size >= r.cut_bytes:
                flush()
                size = 0
    flush()
    if not found:
        return
    own, place, count, key, digest = (np.concatenate(x) for x in zip(*found))
    first, others = _told_apart(own, place, key.view(np.uint64), digest.view(np.uint64))
    sizes = count + (r.length - 1)
    kept = pa.array([contents[k] for k in first.tolist()], pa.binary()) if keep else pa.nulls(len(first), pa.binary())
    names = [c.split()[0] for c in CUT.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[first]), pa.array(digest[first]), pa.array(own[first]), pa.array(place[first]), pa.array(sizes[first].astype(np.int32)), kept], names
    )
    own, place, sizes = _joined(own[others], place[others], sizes[others])
    none = pa.nulls(len(own), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, pa.array(own), pa.array(place), pa.array(sizes.astype(np.int32)), pa.nulls(len(own), pa.binary())], names
    )


def _cut(rows: DataFrame, anchor: int, r: Repeats, keep: bool) -> DataFrame:
    """Passages of ``rows`` (id, place, text as binary) in the form of CUT; rows without a key are bytes to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        places: list[np.ndarray] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            at = 0
            held = batch.column(2).to_pylist()
            sizes = np.cumsum([len(x) for x in held])
            while at < len(held):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + r.batch_bytes)))
                ids.append(batch.column(0).to_numpy()[at:end])
                places.append(batch.column(1).to_numpy()[at:end])
                texts += held[at:end]
                size += int(sizes[min(end, len(held)) - 1] - (sizes[at - 1] if at else 0))
                at = end
                if size >= r.batch_bytes:
                    yield from _cut_batch((np.concatenate(ids), np.concatenate(places), texts), anchor, r, keep)
                    ids, places, texts, size = [], [], [], 0
        if texts:
            yield from _cut_batch((np.concatenate(ids), np.concatenate(places), texts), anchor, r, keep)

    return rows.select("id", "place", "text").mapInArrow(run, CUT)


# --- telling equal passages apart over all documents -------------------------------------------


SORTED = "key long, id long, place long, bytes int, content binary, fate boolean"


def _anchor_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 16)


def _grouped(cut: DataFrame, hot: DataFrame) -> DataFrame:
    """Fates (bytes to remove) and the passages whose anchor has several different ones, in the form of SORTED.

    Passages of an anchor meet in one task, but those of hot anchors are dealt by their own hash:
    equal ones still meet, and all different ones go on. A task holds two rows at a time.
    """
    own = cut.join(F.broadcast(hot), _anchor_of(F.col("key")) == F.col("hot"), "left")
    own = own.withColumn("deal", F.when(F.col("key").isNull(), F.xxhash64("id", "place")).when(F.col("hot").isNotNull(), F.xxhash64("key", "digest")).otherwise(F.xxhash64(_anchor_of(F.col("key")))))
    count = max(partitions(cut.sparkSession), 1)
    ordered = own.repartition(count, "deal").sortWithinPartitions("key", "digest", "id", "place")
    ordered = ordered.select("key", "digest", "id", "place", "bytes", "content", F.col("hot").isNotNull().alias("hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SORTED.split(", ")]
        pending: pa.RecordBatch | None = None  # the first passage of an anchor that has shown no other yet

        def rows(batch: pa.RecordBatch, keep: np.ndarray, fate: bool) -> pa.RecordBatch:
            taken = batch.take(pa.array(np.flatnonzero(keep)))
            columns = [taken.column(c) for c in ("key", "id", "place", "bytes", "content")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(taken.num_rows, fate))], names)

        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keyless = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            if keyless.any():
                yield rows(batch, keyless, True)
                batch = batch.filter(pa.array(~keyless))
                if not batch.num_rows:
                    continue
            key, digest, own, place = (batch.column(c).to_numpy() for c in ("key", "digest", "id", "place"))
            anchor = key.view(np.uint64) >> np.uint64(16)
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            before = last or (0, 0, 0, 0)
            k, d, i, p = (np.concatenate([np.array([b], dtype=x.dtype), x[:-1]]) for b, x in zip(before, (key, digest, own, place)))
            if last is None:
                k[0] = ~key[0]
            near = anchor == k.view(np.uint64) >> np.uint64(16)
            same = (key == k) & (digest == d)
            again = same & (own == i) & (place == p)
            last = (key[-1], digest[-1], own[-1], place[-1])
            yield rows(batch, same & ~again, True)
            # of different passages the first is held until its anchor shows another one
            first = np.flatnonzero(~same)
            if not len(first):
                continue
            if pending is not None and near[first[0]]:
                yield rows(pending, np.ones(1, dtype=bool), False)
            if pending is not None:
                pending = None
            later = near[first]
            followed = np.append(later[1:], False)
            shown = later | followed | hot[first]
            keep = np.zeros(batch.num_rows, dtype=bool)
            keep[first[shown]] = True
            yield rows(batch, keep, False)
            if not shown[-1]:
                pending = batch.slice(int(first[-1]), 1)

    return ordered.mapInArrow(run, SORTED)


# --- the index ---------------------------------------------------------------------------------


class RunIndex:
    """The Burrows-Wheeler transform of some byte strings, kept as samples at both ends of its runs.

    Strings end in separators that differ and rank by place. For each run the index keeps where
    its first row stands in the text, which suffix precedes it in order and how long both agree,
    and likewise what follows its last row. Between two samples all of this moves on in step, so
    that the samples suffice to tell the neighbours in order of every place: its matching statistics.
    """

    STEP = 7  # symbols of 9 bits in a word

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(x) for x in strings], dtype=np.int64)
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        self.size = int(lengths.sum()) + len(strings)
        symbols = np.zeros(self.size + self.STEP, dtype=np.int64)
        inside = np.ones(self.size, dtype=bool)
        inside[self.begins + lengths] = False
        symbols[: self.size][inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
        ends = np.repeat(self.begins + lengths, lengths + 1)
        #: Bytes from a place to the end of its string.
        self.left = ends - np.arange(self.size)
        words = np.zeros(self.size, dtype=np.int64)
        for k in range(self.STEP):
            words = (words << 9) | np.where(self.left > k, symbols[k : k + self.size], 0)
        order = self._sorted(words)
        transform = symbols[order - 1]
        transform[order == 0] = 0
        head = np.ones(self.size, dtype=bool)
        head[1:] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:] - 1, self.size - 1)
        self.runs = len(starts)
        self.before = self._samples(order, starts, starts - 1, words)
        self.after = self._samples(order, ends, ends + 1, words)

    def _sorted(self, words: np.ndarray) -> np.ndarray:
        """Places in the order of their suffixes, by doubling the length compared; settled places are left out."""
        n = self.size
        order = np.argsort(words, kind="stable")
        rank = np.zeros(n + 1, dtype=np.int64)
        sorted_words = words[order]
        new = np.ones(n, dtype=bool)
        new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (self.left[order[1:]] < self.STEP)
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        slots = np.flatnonzero(~new | np.append(~new[1:], False))  # places in order that are not settled
        compared = self.STEP
        while len(slots):
            places = order[slots]
            keys = (rank[places] << 32) | rank[np.minimum(places + compared, n)]
            by = np.argsort(keys, kind="stable")
            places, keys = places[by], keys[by]
            order[slots] = places
            new = np.ones(len(slots), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            slots = slots[~new | np.append(~new[1:], False)]
            compared *= 2
        return order

    def _samples(self, order: np.ndarray, rows: np.ndarray, others: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """By place in the text: sampled places, their neighbours in order, and how many bytes both share."""
        there = (others >= 0) & (others < self.size)
        place, neighbour = order[rows], np.where(there, order[np.clip(others, 0, self.size - 1)], 0)
        agree = np.zeros(len(rows), dtype=np.int64)
        most = np.where(there, np.minimum(self.left[place], self.left[neighbour]), 0)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            a, b = place[alive] + agree[alive], neighbour[alive] + agree[alive]
            differ = words[a] ^ words[b]
            same = np.full(len(alive), self.STEP)
            for k in range(self.STEP):
                same[(differ >> (9 * k)) & 511 != 0] = self.STEP - 1 - k
            agree[alive] += same
            alive = alive[(same == self.STEP) & (agree[alive] < most[alive])]
        by = np.argsort(place, kind="stable")
        return place[by], neighbour[by], np.minimum(agree, most)[by]

    def neighbours(self, places: np.ndarray, samples: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """For each place its neighbour in order, and the bytes both share, read off the sample at or before it."""
        at, other, agree = samples
        k = np.searchsorted(at, places, "right") - 1
        step = places - at[k]
        return other[k] + step, agree[k] - step

    def statistics(self, places: np.ndarray) -> np.ndarray:
        """The length of the longest match of each place with any other place."""
        found = [self.neighbours(places, s)[1] for s in (self.before, self.after)]
        return np.maximum(np.maximum(*found), 0)

    def repeats(self, length: int) -> np.ndarray:
        """Places whose next ``length`` bytes also stand at an earlier place.

        Places stream through the index; those that match a neighbour for ``length`` bytes are
        linked to it. Such links chain all places with the same bytes; jumping along them, twice
        as far each time, finds the earliest.
        """
        places = np.flatnonzero(self.left >= length)
        least = places.copy()
        number = np.zeros(self.size, dtype=np.int64)
        number[places] = np.arange(len(places))
        for samples in (self.before, self.after):
            other, shared = self.neighbours(places, samples)
            linked = shared >= length
            to = np.where(linked, number[np.where(linked, other, 0)], np.arange(len(places)))
            first = places.copy()
            while True:
                first = np.minimum(first, first[to])
                further = to[to]
                if np.array_equal(further, to):
                    break
                to = further
            least = np.minimum(least, first)
        return places[least < places]


def _indexed(rows: DataFrame, r: Repeats) -> DataFrame:
    """Fates of the passages (key, id, place, content): bytes of strings that stand in an earlier passage too."""
    count = partitions(rows.sparkSession)
    ordered = rows.withColumn("anchor", _anchor_of(F.col("key"))).select("anchor", "id", "place", "content")
    ordered = ordered.repartition(count, "anchor").sortWithinPartitions("anchor", "id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        places: list[int] = []
        strings: list[bytes] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            index = RunIndex(strings)
            at = index.repeats(r.length)
            if len(at):
                string = np.searchsorted(index.begins, at, "right") - 1
                own = np.array(ids, dtype=np.int64)[string]
                place = np.array(places, dtype=np.int64)[string] + at - index.begins[string]
                columns = _joined(own, place, np.full(len(at), r.length, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], [c.split()[0] for c in FATES.split(", ")]
                )

        for batch in batches:
            for anchor, own, place, content in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and size >= r.index_bytes:
                    yield from flush()
                    ids, places, strings, size = [], [], [], 0
                last = anchor
                ids.append(own)
                places.append(place)
                strings.append(content)
                size += len(content)
        if strings:
            yield from flush()

    return ordered.mapInArrow(run, FATES)


# --- the operator --------------------------------------------------------------------------------


def _hot(cut: DataFrame, of: int) -> DataFrame:
    """Anchors with a large part of a sample's passages; at most 4 x partitions rows. Only dealing depends on them."""
    counts = cut.where(F.col("key").isNotNull()).groupBy(_anchor_of(F.col("key")).alias("hot")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where("n > 8"), "anchor-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(8, total // (4 * of))).select("hot")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, id (null ids last), place (31 bits of the text's hash in the upper half) and the text as bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    tag = F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)), 32)
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), tag.alias("place"), "text")


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted passages (key, id, place, bytes) with their bytes; the planner joins by measured sizes."""
    high = F.lit(-(1 << 32))
    listed = wanted.groupBy(F.col("id").alias("w_id"), F.col("place").bitwiseAND(high).alias("w_place")).agg(
        F.collect_list(F.struct("key", "place", "bytes")).alias("wanted")
    )
    joined = docs.join(listed, (docs["id"] == F.col("w_id")) & (docs["place"] == F.col("w_place")))
    # rows that repeat in full give the same passages
    rows = joined.select("id", "text", F.explode("wanted").alias("w")).select("id", "w.*", "text")
    first = (F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) + 1).cast("int")
    return rows.select("key", "id", "place", F.substring(F.col("text"), first, F.col("bytes")).alias("content"))


def _level(cut: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    grouped = written(_grouped(cut, hot), "passages")
    return grouped.where("fate").select("id", "place", "bytes"), grouped.where("not fate").drop("fate")


def fates(docs: DataFrame, r: Repeats) -> DataFrame:
    """Byte ranges (id, place, bytes) to remove from ``docs`` (id, place, text), as written tables."""
    spark = docs.sparkSession
    sample = docs.where(F.pmod(F.xxhash64("id", "place", F.lit("hot")), F.lit(64)) == 0)
    hot = _hot(_cut(sample, r.anchors[0], r, False), partitions(spark))
    found, several = _level(_cut(docs, r.anchors[0], r, False), hot)
    rows = written(_contents(docs, several).dropDuplicates(["id", "place"]), "contents")
    nothing = spark.createDataFrame([], "hot long")
    for anchor in r.anchors[1:]:
        sizes = rows.groupBy(_anchor_of(F.col("key")).alias("many")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > r.group)
        many = written(sizes.select("many"), "many-passages")
        if many.isEmpty():
            break
        shared = _anchor_of(rows["key"]) == F.col("many")
        found = found.union(_indexed(small_first(rows, many, shared, "left_anti"), r))
        again = small_first(rows, many, shared, "left_semi").select("id", "place", F.col("content").alias("text"))
        more, rows = _level(_cut(again, anchor, r, True), nothing)
        found = found.union(more)
    return written(found.union(_indexed(rows, r)), "fates")


def remove_repeats(docs: DataFrame, r: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row, without the bytes that repeat.

    Texts are UTF-8 bytes, null ones empty. A byte goes when some string of ``r.length`` bytes
    that covers it also starts earlier: in a document with a smaller id, or earlier in the same
    document; all strings are judged on the input. spans lists the maximal removed runs as
    first:end (end exclusive), comma-joined. Null ids come last; texts that share an id rank by a
    hash of the text; of rows that repeat id and text one is the first and the others repeat it.
    Texts shorter than ``r.length`` stay whole; an empty table gives no rows; other columns are
    not read.

    Strings are dealt by their anchors, the grams of least hash in them. Passages (runs of strings
    with one anchor) that equal an earlier one go by their hashes alone. The different passages of
    an anchor go into a run-length index; their matching statistics show which strings stand in
    an earlier passage. Anchors with more passages than one index takes are split by longer
    anchors, up to the whole string, so no group is capped. Passages are shuffled as hashes;
    texts are read again for those that need an index and for the result.
    """
    numbered = _numbered(docs, id_col, text_col)
    found = fates(numbered, r)
    high = F.lit(-(1 << 32))
    first = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    spans = found.groupBy(F.col("id").alias("f_id"), F.col("place").bitwiseAND(high).alias("f_place")).agg(
        F.sort_array(F.collect_list(F.struct(first.cast("int").alias("first"), "bytes"))).alias("spans")
    )
    twice = numbered.groupBy("id", "place").count().where("count > 1")
    if twice.isEmpty():
        rows = numbered.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = numbered.groupBy("doc_id", "id", "place", "text").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(spans, (rows["id"] == F.col("f_id")) & (rows["place"] == F.col("f_place")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, text, copies, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((own, *_kept(text, [(x["first"], x["first"] + x["bytes"]) for x in ranges or ()])))
                whole = [(0, len(text))] if len(text) >= r.length else []
                out += [(own, *_kept(text, whole))] * (copies - 1)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return joined.select("doc_id", "text", "copies", "spans").where("copies > 0").mapInArrow(run, RESULT)


def _kept(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str, str]:
    """Counts, digest of the bytes that stay, and the removed runs, from ranges sorted by their first byte."""
    runs: list[list[int]] = []
    for first, end in ranges:
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    digest, at = hashlib.sha256(), 0
    for first, end in runs:
        digest.update(text[at:first])
        at = end
    digest.update(text[at:])
    told = ",".join(f"{a}:{b}" for a, b in runs)
    return len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), told
