"""N-grams of a batch of cleaned texts, counted and looked up in arrays.

The n-grams are those of ``functions.ngrams``. A text repeats words and a batch does more so:
character windows are taken once per distinct word and spread over the texts that hold it, and
runs of words are told apart by numbers, so that only distinct n-grams become strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that are sorted or summed at a time; a longer text is taken alone.
ENTRIES = 500_000
#: Rows of one batch of counts.
EMITTED = 100_000
#: Bytes of text that are counted, or weighed, at a time; a longer text is taken alone.
COUNTED, WEIGHED = 4_000_000, 1_000_000
COUNTS = "kind string, term string, cf long, df long"
FIELDS = pa.schema([("kind", pa.string()), ("term", pa.string()), ("cf", pa.int64()), ("df", pa.int64())])


def pieces(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in order, as many at a time as hold ``size`` bytes, and one at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    top = done = 0
    while top < len(texts):
        end = max(top + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield texts.slice(top, end - top)
        top, done = end, int(ends[end - 1])


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _new(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


@dataclass
class Tokens:
    """The words of some texts in order: the text and the distinct word of each."""

    text: np.ndarray
    word: np.ndarray
    words: pa.Array
    texts: int

    @staticmethod
    def of(texts: pa.Array) -> Tokens:
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        filled = pc.not_equal(flat, "")
        coded = flat.filter(filled).dictionary_encode()
        number = np.repeat(np.arange(len(texts)), sizes)[filled.to_numpy(zero_copy_only=False)]
        return Tokens(number, coded.indices.to_numpy().astype(np.int64), coded.dictionary, len(texts))

    def long_ones(self) -> Tokens:
        """Words of at least two characters."""
        keep = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)[self.word] >= 2 if len(self.word) else slice(None)
        return Tokens(self.text[keep], self.word[keep], self.words, self.texts)

    def slices(self, weight: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that end with a text and weigh at most ``ENTRIES``, if one text does not more."""
        ends = np.searchsorted(self.text, np.arange(self.texts), side="right")
        total = np.concatenate([[0], np.cumsum(weight)])
        begin = first = 0
        while first < self.texts:
            last = int(np.searchsorted(total[ends], total[begin] + ENTRIES, side="right"))
            first = max(last, first + 1)
            end = int(ends[first - 1])
            if end > begin:
                yield begin, end
            begin = end

    def per_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and number of occurrences of the words that differ within a text, in order of texts."""
        size = max(len(self.words), 1)
        key, times = np.unique(self.text * size + self.word, return_counts=True)
        return key // size, key % size, times


def _rest(owner: np.ndarray, owners: int) -> np.ndarray:
    """How many symbols of the same owner stand from each one on."""
    sizes = np.bincount(owner, minlength=owners)
    return np.cumsum(sizes)[owner] - np.arange(len(owner)) if len(owner) else owner


def _runs(symbol: np.ndarray, rest: np.ndarray, base: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length the places where a run of it begins, and numbers that are equal for equal runs."""
    at, key = np.arange(len(symbol)), symbol
    for n in range(1, high + 1):
        if n > 1:
            keep = rest[at] >= n
            at, key = at[keep], key[keep]
            if len(key) and int(key.max()) >= (1 << 62) // base:
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + symbol[at + n - 1]
        yield n, at, key


def _strings(points: np.ndarray) -> pa.Array:
    """Strings of the code points in each row."""
    sizes = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    data = np.ascontiguousarray(points, dtype="<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with a blank on either side, and the word of each."""
    text = " " + "  ".join(words.to_pylist()) + " " if len(words) else ""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return points, np.repeat(np.arange(len(words)), sizes)


def _numbered(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points numbered from 1 up, and the base that runs of them are written in."""
    if not len(points):
        return points.astype(np.int64), 2
    table = np.zeros(int(points.max()) + 1, dtype=np.int64)
    table[points] = 1
    return np.cumsum(table)[points], int(table.sum()) + 1


def _emit(kind: str, terms: pa.Array, cf: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    for top in range(0, len(cf), EMITTED):
        end = slice(top, top + EMITTED)
        some = terms.slice(top, EMITTED)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind]).take(pa.array(np.zeros(len(some), dtype=np.int32))), some, pa.array(cf[end].astype(np.int64)), pa.array(df[end].astype(np.int64))],
            schema=FIELDS,
        )


def _word_counts(tokens: Tokens, start: int, high: int, low: int, parts: pa.Array | None) -> Iterator[pa.RecordBatch]:
    tokens = tokens.long_ones()
    for begin, end in tokens.slices(np.ones(len(tokens.word), dtype=np.int64)):
        text, word = tokens.text[begin:end] - tokens.text[begin], tokens.word[begin:end]
        rest = _rest(text, int(text[-1]) + 1)
        held = None
        for n, at, key in _runs(word, rest, len(tokens.words), high):
            if n < start and (parts is None or n != low):
                continue
            if held is not None:
                keep = held[at] & held[at + n - low]
                at, key = at[keep], key[keep]
            order = np.argsort(key, kind="stable")
            at, new = at[order], _new(key[order])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            columns = [tokens.words.take(pa.array(word[at[first] + j])) for j in range(n)]
            terms = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, " ")
            if parts is not None and n == low:
                known = pc.is_in(terms, value_set=parts).to_numpy(zero_copy_only=False)
                held = np.zeros(len(word), dtype=bool)
                held[at] = known[np.cumsum(new) - 1]
            if n >= start:
                # a stable order keeps the texts of equal runs together
                df = np.add.reduceat((new | _new(text[at])).astype(np.int64), first)
                yield from _emit("w", terms, np.diff(np.append(first, len(at))), df)


def _char_counts(tokens: Tokens, start: int, high: int, low: int, parts: pa.Array | None) -> Iterator[pa.RecordBatch]:
    points, owner = _code_points(tokens.words)
    symbol, base = _numbered(points)
    rest, held = _rest(owner, len(tokens.words)), None
    begins = _new(owner)
    owners, numbers, terms, count = [], [], [], 0
    for n, at, key in _runs(symbol, rest, base, high):
        if n < low:
            # a word shorter than the lowest order counts once as a whole
            keep = begins[at] & (rest[at] == n) if start == low else np.zeros(len(at), dtype=bool)
            at, key = at[keep], key[keep]
        elif n < start and (parts is None or n != low):
            continue
        if held is not None:
            keep = held[at] & held[at + n - low]
            at, key = at[keep], key[keep]
        if not len(at):
            if parts is not None and n == low:
                held = np.zeros(len(points), dtype=bool)
            continue
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        names = _strings(points[at[first][:, None] + np.arange(n)])
        if parts is not None and n == low:
            held = np.zeros(len(points), dtype=bool)
            held[at] = pc.is_in(names, value_set=parts).to_numpy(zero_copy_only=False)[number]
        if n >= start or n < low:
            owners.append(owner[at])
            numbers.append(number + count)
            terms.append(names)
            count += len(names)
    if not count:
        return
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    times = np.bincount(tokens.word, minlength=len(tokens.words))
    cf = np.zeros(count, dtype=np.int64)
    np.add.at(cf, number, times[owner])
    # the n-grams that differ within a word, word by word
    pair = np.sort(owner * count + number)
    pair = pair[_new(pair)]
    number, sizes = pair % count, np.bincount(pair // count, minlength=len(tokens.words))
    text, word, _ = tokens.per_text()
    distinct = Tokens(text, word, tokens.words, tokens.texts)
    begins, df = _starts(sizes), np.zeros(count, dtype=np.int64)
    for begin, end in distinct.slices(sizes[word]):
        own = word[begin:end]
        lengths = sizes[own]
        entry = np.repeat(begins[own] - _starts(lengths), lengths) + np.arange(lengths.sum())
        seen = np.repeat((text[begin:end] - text[begin]) * count, lengths) + number[entry]
        seen.sort()
        df += np.bincount(seen[_new(seen)] % count, minlength=count)
    yield from _emit("c", pa.concat_arrays(terms), cf, df)


def counts(
    texts: pa.Array, orders: dict[str, tuple[int, int]], low: dict[str, int], parts: dict[str, pa.Array] | None = None
) -> Iterator[pa.RecordBatch]:
    """(kind, term, cf, df) of the n-grams of some texts; a term may come in several rows with counts of its own.

    ``orders`` are the lengths per kind; with ``parts`` only n-grams that begin and end in one of
    those of the length ``low`` are counted.
    """
    tokens = Tokens.of(texts)
    of_kind = {"w": _word_counts, "c": _char_counts}
    for kind, (start, high) in orders.items():
        yield from of_kind[kind](tokens, start, high, low[kind], None if parts is None else parts[kind])


class Trie:
    """Terms as runs of symbols, found in other runs level by level."""

    def __init__(self, terms: Sequence[Sequence[str]], features: np.ndarray):
        self.symbols = sorted({s for term in terms for s in term})
        number = {s: i for i, s in enumerate(self.symbols)}
        sizes = np.array([len(t) for t in terms])
        self.keys: list[np.ndarray] = []
        self.features: list[np.ndarray] = []
        node = np.zeros(len(terms), dtype=np.int64)
        for n in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes > n)
            key = node[some] * len(self.symbols) + np.array([number[terms[t][n]] for t in some], dtype=np.int64)
            found, node[some] = np.unique(key, return_inverse=True)
            feature = np.full(len(found), -1, dtype=np.int64)
            ends = some[sizes[some] == n + 1]
            feature[node[ends]] = features[ends]
            self.keys.append(found)
            self.features.append(feature)

    def find(self, symbol: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a term begins, and its feature; a symbol of no term is -1."""
        at, node = np.arange(len(symbol)), np.zeros(len(symbol), dtype=np.int64)
        places, found = [], []
        for n, (keys, feature) in enumerate(zip(self.keys, self.features)):
            keep = rest[at] > n
            at, node = at[keep], node[keep]
            next_ = symbol[at + n]
            key = node * len(self.symbols) + next_
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            keep = (next_ >= 0) & (keys[node] == key)
            at, node = at[keep], node[keep]
            hit = feature[node] >= 0
            places.append(at[hit])
            found.append(feature[node[hit]])
        return np.concatenate(places), np.concatenate(found)


class Weights:
    """TF-IDF weights of occurrences, each kind of unit length."""

    def __init__(self, idf: dict[str, np.ndarray], sublinear: bool):
        self.sublinear, self.kinds = sublinear, len(idf)
        self.kind = np.concatenate([np.full(len(of_kind), i) for i, of_kind in enumerate(idf.values())])
        self.idf = np.concatenate(list(idf.values()))
        self.size = len(self.idf)

    def weights(self, lengths: np.ndarray, features: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights of the features of some texts, given how many each has."""
        w = (1.0 + np.log(times) if self.sublinear else times) * self.idf[features]
        block = np.repeat(np.arange(len(lengths)) * self.kinds, lengths) + self.kind[features]
        return w / np.sqrt(np.bincount(block, weights=w * w))[block]


class Weigher(Weights):
    """TF-IDF weights of texts by a fitted vocabulary, each kind of unit length."""

    def __init__(self, terms: dict[str, list[str]], idf: dict[str, np.ndarray], sublinear: bool):
        super().__init__({k: idf[k] for k in terms}, sublinear)
        self.tries, size = {}, 0
        for kind, of_kind in terms.items():
            features = np.arange(size, size + len(of_kind))
            self.tries[kind] = Trie([t.split(" ") if kind == "w" else t for t in of_kind], features)
            size += len(of_kind)

    def entries(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, feature and number of occurrences, a few texts at a time in order; a feature may come repeatedly."""
        tokens = Tokens.of(texts)
        text, word, times = tokens.per_text()
        long = tokens.long_ones()
        sizes = np.zeros(len(tokens.words), dtype=np.int64)
        if "w" in self.tries:
            trie = self.tries["w"]
            known = pc.fill_null(pc.index_in(tokens.words, pa.array(trie.symbols, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at, of_run = trie.find(known[long.word], _rest(long.text, tokens.texts))
            order = np.argsort(at, kind="stable")
            run_text, of_run = long.text[at[order]], of_run[order]
        if "c" in self.tries:
            trie = self.tries["c"]
            points, owner = _code_points(tokens.words)
            letters = np.array([ord(s) for s in trie.symbols], dtype=np.int64)
            place = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
            symbol = np.where(letters[place] == points, place, -1)
            at, of_word = trie.find(symbol, _rest(owner, len(tokens.words)))
            order = np.argsort(owner[at], kind="stable")
            of_word, sizes = of_word[order], np.bincount(owner[at], minlength=len(tokens.words))
        begins = _starts(sizes)
        distinct = Tokens(text, word, tokens.words, tokens.texts)
        for begin, end in distinct.slices(sizes[word] + 1):
            out = []
            if "w" in self.tries:
                own = slice(*np.searchsorted(run_text, [text[begin], text[end - 1] + 1]))
                out.append((run_text[own], of_run[own], np.ones(own.stop - own.start)))
            if "c" in self.tries:
                own = word[begin:end]
                lengths = sizes[own]
                entry = np.repeat(begins[own] - _starts(lengths), lengths) + np.arange(lengths.sum())
                out.append((np.repeat(text[begin:end], lengths), of_word[entry], np.repeat(times[begin:end], lengths).astype(float)))
            yield tuple(np.concatenate(column) for column in zip(*out))

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features in each text, and flat features and occurrences, in order of texts and features."""
        lengths, features, counts = np.zeros(len(texts), dtype=np.int64), [], []
        rows = max(1, 4 * ENTRIES // self.size)
        for text, feature, times in self.entries(texts):
            for top in range(int(text.min(initial=len(texts))), int(text.max(initial=-1)) + 1, rows):
                # laid out densely, a few texts at a time
                some = (text >= top) & (text < top + rows)
                if not some.any():
                    continue
                cell = np.bincount((text[some] - top) * self.size + feature[some], weights=times[some], minlength=rows * self.size)
                held = np.flatnonzero(cell)
                lengths[top : top + rows] += np.bincount(held // self.size, minlength=rows)[: len(texts) - top]
                features.append((held % self.size).astype(np.int32))
                counts.append(cell[held].astype(np.int64))
        return lengths, np.concatenate(features or [np.zeros(0, dtype=np.int32)]), np.concatenate(counts or [np.zeros(0, dtype=np.int64)])

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features in each text, and flat features and weights, in order of texts and features."""
        lengths, features, times = self.counted(texts)
        return lengths, features, self.weights(lengths, features, times)
