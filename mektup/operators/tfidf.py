"""Vocabulary statistics and TF-IDF weights of word and character n-grams.

Fitting counts, per n-gram, its occurrences and the texts it occurs in; tasks count whole batches
in arrays, and both counts combine on the map side. The shortest n-grams are counted first, and
longer ones only where those they are made of are frequent enough to stay; the cut to the cap is found by histograms. The kept vocabulary is capped, so it may
travel to every task. Applying it never explodes nor shuffles: one vectorised Arrow step finds the
kept n-grams of a whole batch of rows and weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions import grambatch
from mektup.session import written

KINDS = ("w", "c")


def kinds_of(config: Config) -> list[str]:
    caps = {"w": config.word_features, "c": config.char_features}
    return [k for k in KINDS if caps[k] > 0]


def _orders(config: Config) -> dict[str, tuple[int, int]]:
    bounds = {"w": config.word_ngrams, "c": config.char_ngrams}
    if bounds["c"][0] < 3 and config.char_features > 0:
        raise ValueError("character n-grams inside word bounds start at 3")
    return {k: bounds[k] for k in kinds_of(config)}


def _counted(
    rows: DataFrame, text: str, orders: dict[str, tuple[int, int]], low: dict[str, int], parts: dict[str, pa.Array] | None = None
) -> DataFrame:
    """(kind, term, cf, df) of the n-grams of the given lengths; with ``parts`` of those alone that begin and end in one.

    Tasks count batch by batch, so that a batch is all they hold; counts combine on the map side.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parts) if parts is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        for batch in batches:
            for texts in grambatch.pieces(batch.column(0), grambatch.COUNTED):
                yield from grambatch.counts(texts, orders, low, wanted)

    counted = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(run, grambatch.COUNTS)
    return counted.groupBy("kind", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def term_stats(rows: DataFrame, config: Config = Config(), text: str = "text_clean") -> DataFrame:
    """(kind, term, cf, df): corpus and document frequency of every n-gram."""
    orders = _orders(config)
    return _counted(rows, text, orders, {k: b[0] for k, b in orders.items()})


#: Frequent short n-grams that may be broadcast; beyond it longer ones are counted without their help.
BROADCAST_PARTS = 1_000_000
#: Cells of a histogram, and terms that are sorted on the driver to find the last one of equal frequency.
CELLS = 1024


def frequency_cut(stats: DataFrame, cap: int) -> tuple[int, int]:
    """The frequency that the ``cap``-th most frequent term has, and how many terms of just that frequency stay.

    (0, 0) when all terms stay. Found by narrowing histograms, first by binary length, so that no
    term is sorted and at most ``CELLS`` counts reach the driver at a time.
    """
    lengths = {r[0]: r[1] for r in stats.groupBy(F.length(F.bin("cf"))).count().collect()}
    if sum(lengths.values()) <= cap:
        return 0, 0
    room = cap
    for bits in sorted(lengths, reverse=True):
        if lengths[bits] >= room:
            break
        room -= lengths[bits]
    low, high = 1 << (bits - 1), 1 << bits
    while high - low > 1:
        step = -(-(high - low) // CELLS)
        inside = stats.filter((F.col("cf") >= low) & (F.col("cf") < high))
        cells = {r[0]: r[1] for r in inside.groupBy(F.floor((F.col("cf") - low) / step).alias("cell")).count().collect()}
        for cell in sorted(cells, reverse=True):
            if cells[cell] >= room:
                break
            room -= cells[cell]
        low, high = low + cell * step, min(high, low + (cell + 1) * step)
    return low, room


def last_of_ties(ties: DataFrame, room: int) -> str:
    """The ``room``-th term in order, found letter by letter."""
    prefix = ""
    while True:
        here = ties.filter(F.col("term").startswith(prefix))
        few = here.select("term").limit(CELLS + 1).collect()
        if len(few) <= CELLS:
            return sorted(r[0] for r in few)[room - 1]
        counts = {r[0]: r[1] for r in here.groupBy(F.substring("term", len(prefix) + 1, 1)).count().collect()}
        for letter in sorted(counts):
            if counts[letter] >= room:
                break
            room -= counts[letter]
        if not letter:
            return prefix
        prefix += letter


def most_frequent(stats: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most frequent terms of ``stats`` (term order on ties); reads a written table a few times."""
    cut, room = frequency_cut(stats, cap)
    if not cut:
        return stats
    last = last_of_ties(stats.filter(F.col("cf") == cut), room)
    return stats.filter((F.col("cf") > cut) | ((F.col("cf") == cut) & (F.col("term") <= last)))


def _as_count(cut: float, n_docs: Column) -> Column:
    """An integer cut is a number of texts, a fraction is a share of them."""
    if isinstance(cut, int) or cut > 1:
        return F.lit(float(cut))
    return F.lit(float(cut)) * n_docs


def vocabulary(
    rows: DataFrame, config: Config = Config(), text: str = "text_clean", n_docs: int | None = None
) -> DataFrame:
    """(kind, term, feature_index, cf, df, idf): the capped vocabulary with its idf weights.

    Terms outside the document-frequency cuts go first, then the most frequent ones up to the cap
    stay (term order on ties). Indices follow term order, words before characters.
    """
    n = F.lit(n_docs) if n_docs is not None else rows.agg(F.count("*")).scalar()
    least, most = _as_count(config.min_df, n), _as_count(config.max_df, n)
    caps = {k: {"w": config.word_features, "c": config.char_features}[k] for k in kinds_of(config)}
    bounds = _orders(config)
    low = {k: b[0] for k, b in bounds.items()}
    # The shortest n-grams first: a longer one is never more frequent than those it is made of.
    shortest = {k: (n, n) for k, n in low.items()}
    short = written(_counted(rows, text, shortest, low).filter(F.col("df") >= least), "short-terms")
    stats = short.filter(F.col("df") <= most)
    more = [k for k in caps if bounds[k][1] > bounds[k][0]]
    if more:
        # what stays in the end is at least as frequent as what the shortest alone would leave
        cuts = {k: frequency_cut(stats.filter(F.col("kind") == k), caps[k])[0] for k in more}
        frequent = reduce(Column.__or__, [(F.col("kind") == k) & (F.col("cf") >= cuts[k]) for k in more])
        parts = short.filter(frequent).select("kind", "term")
        found = parts.limit(BROADCAST_PARTS + 1).toArrow()
        fits = found.num_rows <= BROADCAST_PARTS
        of_kind = {k: found.filter(pc.equal(found["kind"], k))["term"].combine_chunks().cast(pa.string()) for k in more} if fits else None
        long = _counted(rows, text, {k: (low[k] + 1, bounds[k][1]) for k in more}, low, of_kind)
        long = long.filter(frequent & (F.col("df") >= least) & (F.col("df") <= most))
        stats = stats.unionByName(written(long, "long-terms"))
    kept = reduce(
        DataFrame.unionByName, [most_frequent(stats.filter(F.col("kind") == k), caps[k]) for k in caps]
    )
    # The vocabulary is capped, so one task can number it.
    in_order = Window.orderBy(F.desc("kind"), "term")
    return kept.select(
        "kind",
        "term",
        (F.row_number().over(in_order) - 1).alias("feature_index"),
        "cf",
        "df",
        (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def feature_names(vocab: DataFrame) -> DataFrame:
    """(feature_index, feature) with ``w:`` and ``c:`` prefixes."""
    return vocab.select("feature_index", F.concat("kind", F.lit(":"), "term").alias("feature"))


@dataclass
class TfidfModel:
    """A fitted vocabulary: terms and idf per block, in feature order."""

    config: Config
    terms: dict[str, list[str]]
    idf: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        return sum(len(t) for t in self.terms.values())

    @property
    def names(self) -> list[str]:
        return [f"{k}:{t}" for k in KINDS for t in self.terms.get(k, [])]

    @staticmethod
    def collect(vocab: DataFrame, config: Config) -> "TfidfModel":
        """Bring a vocabulary table to the driver; its size is capped by the configuration."""
        table = vocab.select("kind", "term", "idf", "feature_index").toPandas()
        table = table.sort_values("feature_index")
        terms, idf = {}, {}
        for kind in KINDS:
            block = table[table["kind"] == kind]
            if len(block):
                terms[kind] = block["term"].tolist()
                idf[kind] = block["idf"].to_numpy(dtype=float)
        if not terms:
            raise ValueError("no terms remain after the document-frequency cuts")
        return TfidfModel(config, terms, idf)

    def weigher(self) -> grambatch.Weigher:
        return grambatch.Weigher(self.terms, self.idf, self.config.sublinear_tf)

    def weights(self) -> grambatch.Weights:
        return grambatch.Weights(self.idf, self.config.sublinear_tf)

    def vectors(self, rows: DataFrame, text: str = "text_clean", output: str = "tfidf") -> DataFrame:
        """Add the sparse TF-IDF vector of every row; each block has unit length."""
        weigher = self.weigher()

        @F.arrow_udf(returnType=VectorUDT())
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # vectors hold several times the bytes of their texts: a batch leaves in pieces
            for batch in batches:
                for texts in grambatch.pieces(batch, grambatch.WEIGHED):
                    yield sparse_array(*weigher.weigh(texts), weigher.size)

        return rows.withColumn(output, weigh(F.col(text).cast("string")))


    def occurrences(self, rows: DataFrame, text: str = "text_clean", output: str = "occurrences") -> DataFrame:
        """Add what the vector of every row follows from, in some two bytes a feature: see :meth:`from_occurrences`."""
        weigher = self.weigher()

        @F.arrow_udf(returnType=OCCURRENCES)
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for texts in grambatch.pieces(batch, grambatch.WEIGHED):
                    lengths, features, times = weigher.counted(texts)
                    gaps = np.diff(features, prepend=0)
                    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
                    gaps[begins] = features[begins]
                    columns = [c for numbers in (gaps, times) for c in _short(lengths, numbers)]
                    yield pa.StructArray.from_arrays(columns, names=[c.split()[0] for c in OCCURRENCES.split(", ")])

        return rows.withColumn(output, count(F.col(text).cast("string")))

    def from_occurrences(self, rows: DataFrame, column: str = "occurrences", output: str = "tfidf") -> DataFrame:
        """Add the vector that :meth:`vectors` gives, from occurrences."""
        weights = self.weights()

        @F.arrow_udf(returnType=VectorUDT())
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                top = 0
                for some in grambatch.pieces(batch.field("gaps"), grambatch.WEIGHED // 4):
                    yield sparse_array(*entries_of(batch.slice(top, len(some)), weights), weights.size)
                    top += len(some)

        return rows.withColumn(output, weigh(F.col(column)))


#: Steps from feature to feature and occurrences, each a byte; larger ones are 255 and stand in full beside them.
OCCURRENCES = "gaps binary, far binary, times binary, many binary"
LARGE = np.dtype("<u4")


def as_bytes(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The numbers of each row as bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row's bytes hold, and all of them."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    count = (int(ends[-1]) - int(ends[0])) // kind.itemsize if len(column) else 0
    flat = np.frombuffer(column.buffers()[2], dtype=kind, count=count, offset=int(ends[0])) if count else np.zeros(0, dtype=kind)
    return np.diff(ends) // kind.itemsize, flat


def _short(lengths: np.ndarray, flat: np.ndarray) -> list[pa.Array]:
    """Numbers as bytes, and those that do not fit one."""
    large = flat >= 255
    row = np.repeat(np.arange(len(lengths)), lengths)
    beside = as_bytes(np.bincount(row[large], minlength=len(lengths)), flat[large].astype(LARGE))
    return [as_bytes(lengths, np.minimum(flat, 255).astype(np.uint8)), beside]


def _full(short: pa.Array, beside: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths, flat = numbers(short, np.dtype(np.uint8))
    flat = flat.astype(np.int64)
    flat[flat == 255] = numbers(beside, LARGE)[1]
    return lengths, flat


def entries_of(structs: pa.Array, weights: grambatch.Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row lengths, flat features and flat weights of a batch of occurrences."""
    lengths, gaps = _full(structs.field("gaps"), structs.field("far"))
    times = _full(structs.field("times"), structs.field("many"))[1]
    total = np.cumsum(gaps)
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    features = total - np.repeat(total[begins] - gaps[begins], lengths[lengths > 0])
    return lengths, features, weights.weights(lengths, features, times)


def ragged(structs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row lengths, flat indices and flat values of a batch of vectors, dense ones included."""
    lists = structs.field("values")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    indices = structs.field("indices").flatten().to_numpy(zero_copy_only=False)
    dense = structs.field("type").to_numpy(zero_copy_only=False) == 1
    if dense.any():
        # A dense vector lists no indices: they are the positions.
        spread = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        spread[~np.repeat(dense, lengths)] = indices
        indices = spread
    return lengths, indices, values


def sparse_array(lengths: np.ndarray, indices: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """Arrow form of sparse vectors."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    n = len(lengths)
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(n, dtype=np.int8)),
            pa.array(np.full(n, size, dtype=np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(indices.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.float64))),
        ],
        names=["type", "size", "indices", "values"],
    )


def fit_tfidf(rows: DataFrame, config: Config = Config(), text: str = "text_clean") -> TfidfModel:
    """Fit the word and character vocabulary on cleaned rows (write them out first)."""
    return TfidfModel.collect(vocabulary(rows, config, text), config)


def tfidf_long(rows: DataFrame, model: TfidfModel, id_column: str = "mail_id") -> DataFrame:
    """(id, feature_index, weight): the TF-IDF matrix as a long table."""
    sparse = model.vectors(rows).select(id_column, F.unwrap_udt("tfidf").alias("_v"))
    return sparse.select(
        id_column,
        F.inline(F.arrays_zip(F.col("_v.indices").alias("feature_index"), F.col("_v.values").alias("weight"))),
    )


def export_tfidf(rows: DataFrame, path: str, config: Config = Config(), id_column: str = "mail_id") -> None:
    """Write the long TF-IDF matrix and the vocabulary below ``path``."""
    vocab_path = f"{path}/vocabulary"
    vocabulary(rows, config).write.mode("overwrite").parquet(vocab_path)
    vocab = rows.sparkSession.read.parquet(vocab_path)
    tfidf_long(rows, TfidfModel.collect(vocab, config), id_column).write.mode("overwrite").parquet(
        f"{path}/matrix"
    )
    feature_names(vocab).coalesce(1).sortWithinPartitions("feature_index").write.mode("overwrite").parquet(
        f"{path}/feature_names"
    )
