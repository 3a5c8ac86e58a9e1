"""Near duplicates by Jaccard similarity of word n-grams: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import KEY, keyed_texts, partitions, row_key, rows_without, small_first
from mektup.llm.groups import Forest, components, grouped
from mektup.session import written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    trees: int = 16
    #: Hashes that a full label of a tree has; prefixes are shortened from here.
    depth: int = 6
    #: Share of the pairs at the least similarity that must share a prefix in some tree.
    recall: float = 0.999
    #: Signatures that agree less often than this are no candidates; five deviations below the similarity.
    agreement: float = 0.6
    #: Members and shingles that a task compares with each other at once; larger groups are cut into blocks.
    block_rows: int = 256
    block_shingles: int = 2_000_000
    #: Cells of a matrix of members and shingles.
    cells: int = 8_000_000

    def prefix(self) -> int:
        """Shorten the prefix until the recall at the least similarity is reached."""
        length = self.depth
        while length > 1 and 1 - (1 - self.similarity**length) ** self.trees < self.recall:
            length -= 1
        return length


_WORD = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(0x10000)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text.

    Words are runs of letters, digits and underscores in lower case. A text with fewer words than
    an n-gram has is one shingle; one without words has none.
    """
    global _powers
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _WORD[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    longest = int(lengths.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.full(2 * longest, _BASE), dtype=np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    h = _mix(np.add.reduceat((points[inside].astype(np.uint64) + np.uint64(1)) * _powers[place], begins))
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + h[k : k + len(total)]
    return np.unique(_mix(total + np.uint64(n)))


def signature(found: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each hash function the top 32 bits of the least value over the shingles."""
    least = np.full(len(hashes[0]), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        values = found[at : at + 1024, None] * hashes[0] + hashes[1]
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def _functions(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    chance = np.random.default_rng(20)
    count = s.trees * s.depth
    odd = chance.integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, chance.integers(0, 2**63, size=count, dtype=np.uint64)


def _signed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, key, set (a digest of the shingles; null without any), n and the signature, tree by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _functions(s)
        for batch in batches:
            sets: list[bytes | None] = []
            signatures: list[bytes | None] = []
            sizes = []
            for text in batch.column(1).to_pylist():
                found = shingles(text, s.words)
                sizes.append(len(found))
                sets.append(_digest(found))
                signatures.append(signature(found, hashes).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "key", "set", "n", "signature"],
            )

    return docs.mapInArrow(run, f"doc_id long, key {KEY}, set binary, n int, signature binary")


def _blocked(rows: DataFrame, key: str, sizes: DataFrame, node: Column) -> DataFrame:
    """Rows once for each pair of blocks (i <= j) they take part in; ``sizes`` has the blocks of each key."""
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        rows.join(sizes, key)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
    )


def trie_links(labels: np.ndarray, signatures: np.ndarray, shortest: int, need: float) -> Iterator[tuple[int, int]]:
    """Candidate links (row, earlier row) of some rows in the order of their labels, a spanning forest of them.

    The sorted labels are a prefix trie. Rows that share the whole label meet first; then the
    prefix is shortened by one hash after the other, which joins neighbouring runs, down to
    ``shortest``. Rows that are not yet connected are candidates when their signatures agree in
    ``need`` places.
    """
    group = np.arange(len(labels))
    for length in range(labels.shape[1], shortest - 1, -1):
        changed = (labels[1:, :length] != labels[:-1, :length]).any(axis=1)
        borders = [0, *(np.flatnonzero(changed) + 1).tolist(), len(labels)]
        for begin, end in zip(borders[:-1], borders[1:]):
            for k in range(begin, end - 1):
                others = np.flatnonzero(group[k + 1 : end] != group[k]) + k + 1
                if not len(others):
                    continue
                for other in others[(signatures[others] == signatures[k]).sum(axis=1) >= need].tolist():
                    if group[other] != group[k]:
                        group[group == group[other]] = group[k]
                        yield other, k


def _candidates(kinds: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) that join all sets whose prefixes meet in a tree and whose signatures agree often enough.

    Each tree's labels are dealt by the shortest prefix that the recall asks for, so that whatever
    shares a longer one lies together, and sorted. A trie, or a pair of blocks of a large one,
    goes to one task, which climbs it from the longest prefixes and returns a spanning forest of
    its candidate pairs, so fewer rows than it got.
    """
    shortest, width = s.prefix(), s.depth * 4
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(s.trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("signature"), t * width + 1, F.lit(shortest * 4))).alias("bucket")),
    )
    members = kinds.select("set", F.inline(labels))
    sizes = members.groupBy("bucket").count().where("count > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("count") / s.block_rows).cast("int").alias("blocks"))
    # Most labels meet no other: signatures join only after these are gone.
    shared = _blocked(members, "bucket", sizes, F.col("set")).select("bucket", "i", "j", "tree", "set")
    dealt = shared.join(kinds.select("set", "signature"), "set").select(
        "bucket", "i", "j", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("label"), "set", "signature"
    )
    ordered = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "label", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(column: pa.ChunkedArray, rows: int) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(rows, -1).astype("<u4")

        for group in grouped(batches, 3):
            nodes = group.column("set").to_pylist()
            label, values = (numbers(group.column(c), len(nodes)) for c in ("label", "signature"))
            pairs = [(nodes[a], nodes[b]) for a, b in trie_links(label, values, shortest, s.agreement * values.shape[1])]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs)], ["a", "b"])

    return ordered.mapInArrow(run, "a binary, b binary")


def _similar(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """Which pairs of sets reach the similarity, from exact sizes of their intersections."""
    n = len(sets)
    lengths = np.array([len(x) for x in sets])
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), lengths)
    shared = np.bincount(index, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[index]
    row, index = row[keep], column[index[keep]]
    common = np.zeros((n, n), dtype=np.float64)
    width = max(1, min(s.cells // n, int(shared.sum())))
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(index, [low, low + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[row[a:b], index[a:b] - low] = 1
        common += part @ part.T
    both = lengths[:, None] + lengths[None, :]
    return common * (1 + s.similarity) >= s.similarity * both - 1e-9


def _verified(members: DataFrame, s: Settings) -> DataFrame:
    """set, peer and links: the documents each set is linked to in a pair of blocks, and one set of its class there."""
    # as many tasks as set, not fewer for few bytes: the work is in the comparisons
    ordered = members.repartition(partitions(members.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            nodes = group.column("set").to_pylist()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            own = group.column("own").to_numpy()
            copies = group.column("copies").to_numpy()
            linked = _similar([np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()], s)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= own[:, None] != own[None, :]
            forest = Forest(len(nodes))
            for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
                forest.join(a, b)
            peers = [nodes[forest.root(k)] for k in range(len(nodes))]
            links = linked.astype(np.int64) @ copies
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(peers, pa.binary()), pa.array(links, pa.int64())], ["set", "peer", "links"]
            )

    return ordered.select("root", "i", "j", "set", "own", "copies", "shingles").mapInArrow(run, "set binary, peer binary, links long")


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _with_shingles(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """set and shingles of the documents with a wanted id; rows that share an id may give further sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in (shingles(t, s.words) for t in batch.column(0).to_pylist()) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["set", "shingles"],
            )

    chosen = small_first(docs, wanted, docs["doc_id"].eqNullSafe(wanted["rep"]), "left_semi")
    return chosen.select("text").mapInArrow(run, "set binary, shingles binary").dropDuplicates(["set"])


def classes(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links and rep_id of every row.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams reaches
    ``s.similarity``; n_links counts a document's links, class_id is the least id of its
    connected component, rep_id the least id with the same shingles. Texts without a word (null
    and empty ones too) have no links and are classes of their own. Null ids are least-known: a
    class has one only if none of its rows has an id. Rows that repeat count as copies.

    Documents with equal shingles are one node. Each tree sorts the nodes' labels into a prefix
    trie. Nodes that share a prefix, the longest first, and whose signatures agree often form clusters; within a cluster every pair is verified exactly,
    in blocks, so pairs are never rows of a table. Prefixes are shortened until the expected
    recall at the least similarity reaches ``s.recall``.
    """
    known, signed = _classed(keyed_texts(docs, id_col, text_col), s)
    each = known.select("set", F.col("rep").alias("rep_id"), "class_id", "n_links")
    own = signed.where(F.col("set").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep_id")
    )
    return signed.select("doc_id", "set").join(each, "set").select("doc_id", "class_id", "n_links", "rep_id").union(own)


def _classed(narrow: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(set, rep, class_id, n_links, keeper) of every set of shingles, and the signed rows; keeper is the least key of the class."""
    signed = written(_signed(narrow, s), "signatures")
    kinds = written(
        signed.where(F.col("set").isNotNull())
        .groupBy("set")
        .agg(
            F.min("doc_id").alias("rep"), F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
            F.max("signature").alias("signature"),
        ),
        "shingle-sets",
    )
    clusters = written(components(_candidates(kinds, s)), "clusters")
    inside = written(
        clusters.join(kinds.select(F.col("set").alias("node"), "rep", "copies", "n"), "node").withColumnRenamed("node", "set"), "clustered"
    )
    sizes = inside.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).select(
        "root",
        F.ceil(F.greatest(F.col("rows") / s.block_rows, F.col("all") / s.block_shingles)).cast("int").alias("blocks"),
    )
    found = _with_shingles(narrow, written(inside.select("rep").distinct(), "wanted"), s)
    members = _blocked(inside.join(found, "set"), "root", sizes, F.col("set"))
    verified = written(_verified(members, s), "verified")
    roots = components(verified.select(F.col("set").alias("a"), F.col("peer").alias("b")))
    links = verified.groupBy("set").agg(F.sum("links").alias("links"))
    known = (
        kinds.select("set", "rep", "first", "copies")
        .join(links, "set", "left")
        .join(roots.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("root", F.coalesce("root", "set"))
    )
    known = written(known, "linked-sets")
    named = known.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("first").alias("keeper"))
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    return known.join(named, "root").select("set", "rep", "class_id", links, "keeper"), signed


def keep_one(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each class of near copies: that with the least id, null ids last.

    Rows are told apart by id and text together. Of rows that repeat both, one stays. Texts
    without a word are classes of their own and all stay. An empty table gives no rows.
    """
    known, signed = _classed(keyed_texts(docs, id_col, text_col), s)
    rows = signed.where(F.col("set").isNotNull()).select("set", "key")
    gone = rows.join(known.select("set", "keeper"), "set").where("key <> keeper").select("key").distinct()
    kept = rows_without(docs, written(gone, "near-copies"), id_col, text_col)
    twice = written(rows.groupBy("key").count().where("count > 1").select("key"), "repeated-rows")
    if twice.isEmpty():
        return kept
    marked = kept.select(F.struct(*kept.columns).alias("row"), row_key(id_col, text_col).alias("own"))
    same = F.col("own") == F.col("key")
    one = small_first(marked, twice, same, "left_semi").dropDuplicates(["own"])
    return small_first(marked, twice, same, "left_anti").union(one).select("row.*")
