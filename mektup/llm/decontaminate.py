"""Passages of a benchmark in documents, found by spaced seeds that tolerate substitutions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import KEY, keyed_texts, rows_without, texts
from mektup.session import written

HITS = "doc_id long, item_id long, matched long, aligned long, doc_word long, item_word long"
#: Scripts that put no blanks between words: each of their characters stands for a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


@dataclass(frozen=True)
class Seeds:
    """Length of a seed, how its masks ignore positions, and what counts as an overlap."""

    span: int = 12
    #: Positions fall into this many classes (by remainder); each mask ignores two of them, so any
    #: two substitutions in a span are ignored by some mask.
    classes: int = 4
    #: An overlap has at least `span` aligned words (or the whole of a shorter item) of which this share is equal.
    share: float = 0.8
    #: Items with fewer words are too short to tell a leak from common speech: they overlap only with a text that is the item.
    least: int = 3
    #: Pairs of places of one hash beyond which their differences come from a correlation, and words searched at once.
    pairs: int = 50_000
    batch_words: int = 200_000
    #: Characters of items that one index may hold; a larger benchmark is searched in several blocks.
    block_chars: int = 16_000_000

    def masks(self) -> list[np.ndarray]:
        at = np.arange(self.span)
        return [at[~np.isin(at % self.classes, pair)] for pair in combinations(range(self.classes), 2)]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def differences(starts: np.ndarray, places: np.ndarray, pairs: int) -> np.ndarray:
    """All values of start - place, each once, without laying out more than ``pairs`` of them.

    Repeated words give many pairs and few differences; those are read off the correlation of the two sets.
    """
    if len(starts) * len(places) <= pairs:
        return np.unique(np.subtract.outer(starts, places))
    low, high = int(starts.min() - places.max()), int(starts.max() - places.min())
    size = 1 << (high - low).bit_length()
    one, two = np.zeros(size), np.zeros(size)
    one[starts - starts.min()] = 1
    two[places.max() - places] = 1
    met = np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size)
    return np.flatnonzero(met[: high - low + 1] > 0.5) + low


class Index:
    """Seed hashes of a block of items, and the search of documents by them."""

    def __init__(self, items: list[tuple[int, str]], seeds: Seeds):
        self.seeds = seeds
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        #: Items that only a whole text can be.
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            found = words(text)
            if found and len(found) < seeds.least:
                self.short.setdefault(tuple(found), []).append(item)
            elif found:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
                self.items.append((item, np.array(ids, dtype=np.int64)))
        self.masks = [(seeds.span, m) for m in seeds.masks()]
        # An item shorter than a span is looked up whole, without each choice of as many words as may differ.
        for length in sorted({len(x) for _, x in self.items if len(x) < seeds.span}):
            free = int(length * (1 - seeds.share) + 1e-9)
            self.masks += [(length, np.delete(np.arange(length), x)) for x in combinations(range(length), free)]
        chance = np.random.default_rng(7)
        self.factors = chance.integers(1, 2**63, size=seeds.span, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables = [self._table(length, mask) for length, mask in self.masks]

    def _hash(self, ids: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(starts), dtype=np.uint64)
        for o in mask.tolist():
            total += (ids[starts + o].astype(np.uint64) + np.uint64(1)) * self.factors[o]
            total ^= total >> np.uint64(29)
        return total

    def _table(self, length: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, numbers, places = [], [], []
        for number, (_, ids) in enumerate(self.items):
            # shorter items have masks of their own length
            if len(ids) >= length and (length == self.seeds.span or len(ids) == length):
                starts = np.arange(len(ids) - length + 1)
                hashes.append(self._hash(ids, starts, mask))
                numbers.append(np.full(len(starts), number))
                places.append(starts)
        if not hashes:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        h, n, p = np.concatenate(hashes), np.concatenate(numbers), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        return h[order], n[order], p[order]

    def search(self, doc_ids: list, docs: list[str]) -> Iterator[tuple]:
        """Rows of HITS: for each document and item the best overlap, if there is one."""
        look = self.vocabulary.get
        found_words = [words(t) for t in docs]
        for own, found in zip(doc_ids, found_words):
            for item in self.short.get(tuple(found), ()) if len(found) < self.seeds.least else ():
                yield own, item, len(found), len(found), 0, 0
        lists = [[look(w, -1) for w in found] for found in found_words]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        gap = self.seeds.span  # unknown words between documents keep spans inside one
        ids = np.full(int(lengths.sum()) + gap * len(docs), -1, dtype=np.int64)
        begins = np.cumsum(lengths + gap) - lengths - gap
        for begin, found in zip(begins.tolist(), lists):
            ids[begin : begin + len(found)] = found
        known = ids >= 0
        # by document of the hit and item: where in ids the item would begin, which may lie documents before
        diagonals: dict[tuple[int, int], list[np.ndarray]] = {}
        for (length, mask), (hashes, numbers, places) in zip(self.masks, self.tables):
            if not len(hashes) or len(ids) < length:
                continue
            usable = np.ones(len(ids) - length + 1, dtype=bool)
            for o in mask.tolist():
                usable &= known[o : o + len(usable)]
            starts = np.flatnonzero(usable)
            wanted = self._hash(ids, starts, mask)
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            hit = np.flatnonzero(high > low)
            # words that count are known, so all of a hit's lie in the document of the first of them
            doc = np.searchsorted(begins, starts[hit] + mask[0], "right") - 1
            # places of one hash in one document, together
            order = np.lexsort((starts[hit], doc, low[hit]))
            hit, doc = hit[order], doc[order]
            new = np.flatnonzero((np.diff(low[hit], prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            for begin, end in zip(new.tolist(), [*new[1:].tolist(), len(hit)]):
                entries = slice(int(low[hit[begin]]), int(high[hit[begin]]))
                of = numbers[entries]
                for number in np.unique(of).tolist():
                    found = differences(starts[hit[begin:end]], places[entries][of == number], self.seeds.pairs)
                    diagonals.setdefault((int(doc[begin]), number), []).append(found)
        for (d, number), found in sorted(diagonals.items()):
            best = self._best(ids, int(begins[d]), int(begins[d] + lengths[d]), number, np.unique(np.concatenate(found)))
            if best:
                matched, aligned, place, item_place = best
                yield doc_ids[d], self.items[number][0], matched, aligned, place, item_place

    def _best(self, ids: np.ndarray, begin: int, end: int, number: int, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
        """The best overlap of a document with an item over the given diagonals, the longest of these first."""
        item = self.items[number][1]
        lows, highs = np.maximum(diagonals, begin), np.minimum(diagonals + len(item), end)
        best: tuple = (0,)
        for k in np.lexsort((lows, lows - highs)).tolist():
            diagonal, low, high = int(diagonals[k]), int(lows[k]), int(highs[k])
            if high - low < best[0]:
                break  # shorter than what is matched already
            if best[0] == len(item) and -best[1] == len(item) and low - begin >= -best[2]:
                continue  # nothing beats the whole item further left
            found = self._overlap(ids[low:high] == item[low - diagonal : high - diagonal], len(item))
            if found:
                matched, aligned, offset = found
                best = max(best, (matched, -aligned, -(low + offset - begin), low - diagonal + offset))
        return (best[0], -best[1], -best[2], best[3]) if best[0] else None

    def _overlap(self, equal: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
        """Best stretch of aligned words (equal, aligned, first), where unequal words cost what `share` makes them cost."""
        # whole numbers: an equal word earns what is left of the share, an unequal one costs the share
        share = round(self.seeds.share * 1000)
        sums = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - share, -share))])
        least = np.minimum.accumulate(sums)
        gains = sums[1:] - least[:-1]
        at = int(gains.argmax()) if len(gains) else 0
        if not len(gains) or gains[at] <= 0:
            return None if len(equal) < min(self.seeds.span, item_words) else self._whole(equal, item_words)
        # the stretch begins after the last of the least sums before its end
        end = at + 1
        begin = int(np.flatnonzero(sums[:end] == least[at])[-1])
        if end - begin < min(self.seeds.span, item_words):
            return self._whole(equal, item_words)
        return int(equal[begin:end].sum()), end - begin, begin

    def _whole(self, equal: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
        """A stretch that is short of the least length only by substitutions at its ends."""
        need = min(self.seeds.span, item_words)
        if len(equal) < need:
            return None
        sums = np.convolve(equal, np.ones(need, dtype=np.int64), "valid")
        at = int(sums.argmax())
        return (int(sums[at]), need, at) if sums[at] >= self.seeds.share * need else None


def overlaps(
    docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id and the best overlap of every document and benchmark item that overlap.

    Words are runs of letters, digits and underscores in lower case. Fixed masks over `span`
    words hash the positions they do not ignore; equal hashes of a document and an item mark a
    diagonal, on which the words are then compared one by one. matched of aligned words are
    equal; doc_word and item_word tell where the stretch begins, in words.

    The benchmark is a query set: its items go to the tasks in blocks of bounded size, one pass
    over the documents for each block, and documents are neither shuffled nor collected. Each
    character of a script without blanks is a word. Items with fewer than `least` words overlap
    with a text that is the item and nothing else. Null and empty texts overlap with nothing;
    repeated items and documents each count; null ids are kept; very long texts and repeated
    words are searched whole. Empty tables give an empty result.
    """
    return _overlaps(texts(docs, id_col, text_col), benchmark, seeds, "doc_id long")


#: The last block's index of this worker process, which tasks after the first find ready.
_READY: dict[str, Index] = {}


def _overlaps(rows: DataFrame, benchmark: DataFrame, seeds: Seeds, own: str) -> DataFrame:
    """Overlaps of ``rows`` (own column, text), which carry the first column along as it is."""
    schema = HITS.replace("doc_id long", own)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // seeds.block_chars
    result = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if name not in _READY:
                    _READY.clear()
                    _READY[name] = Index(held.value, seeds)
                text = batch.column(1).to_pylist()
                found: list[tuple] = []
                # whole documents, up to a number of words (a word takes at least two characters, mostly six)
                at, sizes = 0, np.cumsum([len(x) for x in text])
                while at < len(text):
                    limit = (int(sizes[at - 1]) if at else 0) + 6 * seeds.batch_words
                    end = min(at + 256, max(at + 1, int(np.searchsorted(sizes, limit, "right"))))
                    found.extend(_READY[name].search(list(range(at, end)), text[at:end]))
                    at = end
                if found:
                    places, *columns = (pa.array(x, pa.int64()) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(places), *columns], [x.split()[0] for x in HITS.split(", ")])

        found = rows.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no benchmark item.

    Rows are judged by id and text together, those without an id too; empty tables drop nothing.
    """
    keyed = keyed_texts(docs).select(F.col("key").alias("doc_id"), "text")
    leaks = _overlaps(keyed, benchmark, seeds, f"doc_id {KEY}").select(F.col("doc_id").alias("key")).distinct()
    return rows_without(docs, written(leaks, "leaks"))
