"""Token sequences of bounded length, cut by an order-preserving dynamic programme."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from mektup.llm.common import texts

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class Costs:
    """What a cut costs, in padding tokens, and where cuts may lie."""

    window: int = 4096
    sentence: float = 8.0
    inside: float = 24.0
    #: Between two boundaries further apart than this there is a possible cut at each multiple of it.
    stride: int = 16
    #: Tokens planned together; the last window of a plan moves on to the next plan.
    plan: int = 1 << 19
    end_id: int = 2


#: Text of which the quick way below knows letters, case and normal form: ASCII and Latin letters.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įĴ-ľŁ-ňŊ-ž]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-įĵ-ľł-ňŋ-žß]+|[0-9]|[^\sa-z0-9à-öø-įĵ-ľł-ňŋ-žß]+")
_KNOWN_WORDS = 400_000


#: Stands for the end of a pre-token where bytes are merged; no plain text has it.
_STOP = "\x01"


def merger(path: str) -> tiktoken.Encoding | None:
    """The byte-pair merges of a tokenizer file for pre-tokens that end in `_STOP`, ids one higher than the file's.

    Merging by rank gives the file's ids if these rise in the order of its merges and the file
    marks word ends with a suffix; for another kind of file there is no merger.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix")
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
    order = [vocabulary.get("".join(x), -1) for x in pairs]
    if suffix != "</w>" or len(set(order)) < len(order) or order != sorted(order):
        return None
    # A byte is written as its Latin-1 character where that is visible, else as one from 256 on.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {}
    for word, i in vocabulary.items():
        body, end = (word[: -len(suffix)], _STOP.encode()) if word.endswith(suffix) else (word, b"")
        if all(c in byte_of for c in body) and body:
            ranks.setdefault(bytes(byte_of[c] for c in body) + end, i + 1)
    return tiktoken.Encoding("pre-tokens", pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts by a tokenizer file whose pre-tokens are encoded one by one.

    A text of plain Latin characters is split into pre-tokens here, and each distinct pre-token is
    encoded once and its ids are looked up from then on (the memory of them is emptied when it
    grows too large). Any other text, and one that holds a special token, goes through the
    tokenizer whole. Both ways give the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        sentence = re.compile(r"[^\w\s]*[.!?][^\w\s]*</w>")
        self.sentence_ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.sentence_ends[[i for word, i in vocabulary.items() if sentence.fullmatch(word)]] = True
        self.word_ends = np.zeros(len(self.sentence_ends), dtype=bool)
        self.word_ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.merger = merger(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Ids of all known pre-tokens on end, and where each begins.
        self.flat, self.begins, self.used = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64), 0

    def whole(self, found: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(found, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Encode pre-tokens in one go; the last id of each ends a word."""
        if self.merger:
            ids = np.array(self.merger.encode_ordinary(_STOP.join(new) + _STOP), dtype=np.int32) - 1
        else:
            ids = np.array(self.whole([" ".join(new)])[0], dtype=np.int32)
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        if len(ends) != len(new):
            each = self.whole(new)
            ids, ends = np.array([i for x in each for i in x], dtype=np.int32), np.cumsum([len(x) for x in each])
        first, count = len(self.known), len(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + count + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begins[first + 1 : first + count + 1] = self.used + ends
        self.used += len(ids)
        self.known.update(zip(new, range(first, first + count)))

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        split, rest = {}, []
        for i, text in enumerate(batch):
            if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                split[i] = _PIECE.findall(text.lower())
            else:
                rest.append(i)
        result = {i: np.array(x, dtype=np.int32) for i, x in zip(rest, self.whole([batch[i] for i in rest]))}
        pieces = list(chain.from_iterable(split.values()))
        if len(self.known) > _KNOWN_WORDS:
            self.forget()
        words = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(words < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys(pieces[k] for k in missing)))
            words[missing] = [self.known[pieces[k]] for k in missing]
        lengths = self.begins[words + 1] - self.begins[words]
        stops = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.begins[words] - (stops - lengths), lengths) + np.arange(lengths.sum())]
        at = np.concatenate([[0], stops])
        done = 0
        for i, found in split.items():
            result[i] = ids[at[done] : at[done + len(found)]]
            done += len(found)
        return [result[i] for i in range(len(batch))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices of the cuts, the last place included, of the cheapest division into windows.

    ``places`` are the rising token positions where a cut may lie, the last one the end, no two
    neighbours (nor 0 and the first) further apart than ``window``. A window costs its padding
    and the penalty of the cut that ends it:
    best(j) = penalty(j) + window - place(j) + min(best(i) + place(i)) over the i in reach,
    and a queue of rising values holds that minimum. Of equal ways the earliest cut wins.
    """
    spots, costs = [0, *places.tolist()], [0.0, *penalties.tolist()]
    best, come = [0.0] * len(spots), [0] * len(spots)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(spots)):
        place = spots[j]
        low = place - window
        while spots[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best[j] = costs[j] + window - place + value
        come[j] = i
        reach = best[j] + place
        while queue and queue[-1][0] > reach:
            queue.pop()
        queue.append((reach, j))
    found, j = [], len(spots) - 1
    while j:
        found.append(j - 1)
        j = come[j]
    return found[::-1]


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int, c: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie in ``total`` tokens, and their penalties: document ends, sentence ends, strides."""
    penalty = np.full(total + 1, np.inf)
    penalty[sentences] = c.sentence
    penalty[ends] = 0.0
    penalty[0], penalty[total] = np.inf, 0.0
    places = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > c.stride)
    if len(wide):
        inside = np.concatenate([np.arange(places[k] - gaps[k] + c.stride, places[k], c.stride) for k in wide])
        penalty[inside] = c.inside
        places = np.flatnonzero(np.isfinite(penalty))
    return places, penalty[places]


def power_sizes(length: int, c: Costs) -> list[int]:
    """The sequence lengths of one window: itself, or powers of two where such cuts cost less than its padding."""
    ones = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    padding = c.window - length if len(ones) > 1 else 0
    return ones if len(ones) > 1 and c.inside * (len(ones) - 1) < padding else [length]


class Packer:
    """Takes documents in order and gives pieces; holds one plan of tokens at most, besides one document."""

    def __init__(self, number: int, ends: np.ndarray, c: Costs):
        self.sequence, self.ends, self.c = number << 40, ends, c
        self.queue: list[tuple[int | None, np.ndarray, int, int]] = []  # id, tokens left, their start, tokens in all
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, self.c.end_id)
        self.queue.append((doc_id, ids, 0, len(ids)))
        self.waiting += len(ids)
        if self.waiting >= self.c.plan:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        tokens = np.concatenate([x[1] for x in self.queue])
        ends = np.cumsum([len(x[1]) for x in self.queue])
        sentences = np.flatnonzero(self.ends[tokens]) + 1
        places, penalties = candidates(ends, sentences, len(tokens), self.c)
        chosen = places[cuts(places, penalties, self.c.window)].tolist()
        if not last:
            chosen.pop()  # what follows may still fill this window
        sizes, at = [], 0
        for cut in chosen:
            sizes.extend(power_sizes(cut - at, self.c))
            at = cut
        yield from self.emit(tokens, sizes)

    def emit(self, tokens: np.ndarray, sizes: list[int]) -> Iterator[tuple]:
        data, at, doc = tokens.astype("<u4"), 0, 0
        queue = self.queue
        for size in sizes:
            offset = 0
            while offset < size:
                doc_id, ids, start, total = queue[doc]
                take = min(size - offset, len(ids))
                crc = zlib.crc32(data[at : at + take].tobytes())
                yield doc_id, start, take, crc, total, self.sequence, offset
                queue[doc] = (doc_id, ids[take:], start + take, total)
                doc += take == len(ids)
                at, offset = at + take, offset + take
            self.sequence += 1
        self.queue = queue[doc:]
        self.waiting = len(tokens) - at


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names)


def pack(docs: DataFrame, tokenizer: str, costs: Costs = Costs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``costs.window`` tokens.

    Documents keep the order of their partition; a partition packs on its own, without a shuffle,
    and numbers its sequences from (partition << 40). Windows end at document or sentence ends,
    or inside sentences at strides, by `cuts`; a window that would need much padding,
    as the last one of a partition, is divided into powers of two, which need none. Null texts
    count as empty and give the end token alone; null and repeated ids are kept as they are;
    texts of any length are cut. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)

        def rows() -> Iterator[tuple]:
            packer = Packer(TaskContext.get().partitionId(), coder.sentence_ends, costs)
            for batch in batches:
                ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(ids), 256):
                    for doc_id, found in zip(ids[at : at + 256], coder.ids(text[at : at + 256])):
                        yield from packer.add(doc_id, found)
            yield from packer.flush(last=True)

        yield from _batches(rows())

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)
