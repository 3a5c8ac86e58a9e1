"""Personal data: base patterns, and further spans by a skip-chain conditional random field."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import bounded_sample, texts

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart: the kinds of the base patterns, and keys or passwords, which it alone finds.
FIELD_KINDS = (*KINDS, "secret")
Span = tuple[int, int, int]  # kind, start, end in code points


@dataclass(frozen=True)
class Settings:
    #: At most about so many texts with a digit or "@" train the field.
    fit_rows: int = 4000
    steps: int = 80
    rate: float = 0.15
    l2: float = 1e-4
    sweeps: int = 10
    #: A token is taken for a kind when its marginal probability reaches this.
    certain: float = 0.6
    #: Shortest key that links tokens which repeat.
    key_chars: int = 6
    #: In rewritten copies of the training texts, the share of features that give a pattern away and are hidden.
    hidden: float = 0.6
    #: Tokens whose messages are passed together.
    batch_tokens: int = 20_000


# --- base patterns -------------------------------------------------------------------------------

# A match can only begin where its run of digits begins, which the look-behind says at once.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = (2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < domain.start():
            end = domain.end()
            yield 0, start, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found.extend((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    return found


# --- graph of one text ---------------------------------------------------------------------------

_ACTIVE = re.compile(r"[0-9@]+")
_EDGE = " \t.,;:!?\"'<>[]{}#$%*&|~^`"
_SECRET = re.compile(r"(?i)token|secret|passw|pwd|api|key|bearer|auth")
_CUE = re.compile(r"(?i)tel|phone|call|fax|mail|card|visa|addr|contact")
_BUCKETS = (2, 4, 5, 8, 12, 16, 20)
FEATURES = 32
#: Features that say outright what the base patterns check: domain, four parts, their range, plus, check digit, cues.
GIVEAWAY = (2, 3, 4, 16, 19, 23, 26, 28)
#: Shortest mixture of letters and digits that may be a key.
SECRET_CHARS = 16


@dataclass
class Graph:
    """Tokens with a digit or "@"; all other tokens of a text are outside (label 0) for certain."""

    places: list[tuple[int, int]]
    features: np.ndarray
    #: Neighbours in the text, and repeated or similar tokens, each with the one before.
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _features(token: str, left: str, alone_left: bool, alone_right: bool) -> np.ndarray:
    x = np.zeros(FEATURES, dtype=np.float32)
    core = token.strip(_EDGE)
    digits = _digits(core)
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    x[0] = 1
    x[1] = "@" in core
    x[2] = bool(_DOMAIN.search(core))
    x[3] = dotted
    x[4] = dotted and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    x[5] = not dotted and "." in core and bool(digits)
    x[6] = any(map(str.isalpha, core))
    x[7] = not x[6] and not x[1]
    x[8 + sum(len(digits) >= b for b in _BUCKETS)] = 1  # to 15
    x[16] = core.startswith("+")
    x[17] = "(" in core and ")" in core
    x[18] = "-" in core
    x[19] = 13 <= len(digits) <= 19 and luhn(digits)
    x[20] = any(c in token for c in "=\"/\\_%$#&*")
    x[21], x[22] = alone_left, alone_right
    last = left.split(" ")[-1]
    x[23] = bool(_CUE.search(left))
    x[24] = bool(x[6]) and all(c in "0123456789abcdef" for c in core)
    x[25] = core.isupper()
    x[26] = last.endswith((":", "="))
    x[27] = len(core) > 20
    x[28] = bool(_SECRET.search(left))
    x[29] = _mixed(core)
    x[30] = len(core) >= SECRET_CHARS and all(c in "0123456789abcdefABCDEF" for c in core)
    quad = re.split(r"\[?[.,-]\]?", core)
    x[31] = len(quad) == 4 and all(p.isdigit() and len(p) <= 3 for p in quad)
    return x


def _mixed(core: str) -> bool:
    return len(core) >= SECRET_CHARS and core.isascii() and core.replace("-", "").replace("_", "").isalnum() and any(map(str.isalpha, core))


def build(text: str, s: Settings) -> Graph:
    places: list[tuple[int, int]] = []
    end = 0
    for m in _ACTIVE.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        places.append((start, end))
    chain = [(k, k + 1) for k in range(len(places) - 1) if text[places[k][1] : places[k + 1][0]].isspace() and places[k + 1][0] - places[k][1] <= 3]
    tied = set(chain)
    follows, leads = {b for _, b in tied}, {a for a, _ in tied}
    rows, last, skip = [], {}, []
    for k, (start, end) in enumerate(places):
        token = text[start:end]
        left = text[max(0, start - 24) : start].split()
        rows.append(_features(token, " ".join(left[-2:]), k not in follows, k not in leads))
        digits = _digits(token)
        key = digits if len(digits) >= s.key_chars and "@" not in token else token.strip(_EDGE).lower()
        if len(key) >= s.key_chars:
            if key in last and (last[key], k) not in tied:
                skip.append((last[key], k))
            last[key] = k
    features = np.stack(rows) if rows else np.zeros((0, FEATURES), dtype=np.float32)
    return Graph(places, features, chain, skip)


UNKNOWN = -1


def silver(graph: Graph, spans: list[Span], text: str = "") -> list[int]:
    """Label of each token: 1 + the kind of the span it shares most characters with, else 0.

    With the ``text`` given, keys after a cue are secrets, and what only looks like one of the
    kinds is unknown: long numbers, dotted quads, "@" and mixed keys without a cue, which the
    patterns neither confirm nor rule out.
    """
    labels = []
    ordered = sorted(spans, key=lambda x: x[1])
    at = 0
    for start, end in graph.places:
        while at < len(ordered) and ordered[at][2] <= start and (at + 1 == len(ordered) or ordered[at + 1][1] <= start):
            at += 1
        best = (0, 0)
        for kind, a, b in ordered[max(0, at - 1) : at + 6]:
            best = max(best, (min(end, b) - max(start, a), kind + 1))
        labels.append(best[1] if best[0] > 0 else 0)
    if text:
        for k, (start, end) in enumerate(graph.places):
            if labels[k] == 0:
                core, x = text[start:end].strip(_EDGE), graph.features[k]
                if x[29]:
                    labels[k] = len(FIELD_KINDS) if x[28] else UNKNOWN
                elif "@" in core or x[3] or (x[7] and len(_digits(core)) >= 9):
                    labels[k] = UNKNOWN
    return labels


def rewritten(text: str, spans: list[Span], chance: random.Random) -> tuple[str, list[Span]]:
    """The text with its base spans in forms that the patterns miss, and where these stand now."""
    out, found, at, size = [], [], 0, 0
    for kind, start, end in sorted(spans, key=lambda x: x[1:]):
        if start < at:
            continue
        old, pick = text[start:end], chance.randrange(3)
        if kind == 0:
            name, _, host = old.partition("@")
            new = (f"{name} @ {host}", f"{name}@{host.split('.')[0]}", f"{name}@ {host}")[pick]
        elif kind == 1:
            new = (old.replace(".", ","), old.replace(".", "-"), old.replace(".", "[.]"))[pick]
        elif kind == 2:
            digits = _digits(old)
            digits = digits[:-1] + str((int(digits[-1]) + chance.randrange(1, 10)) % 10)
            new = (digits, " ".join(digits[k : k + 4] for k in range(0, len(digits), 4)), digits[:8] + "\n" + digits[8:])[pick]
        else:
            new = (old[1:].strip(), old[1:].lstrip("0123456789").strip() or old[1:], _digits(old))[pick]
        out += [text[at:start], new]
        size += start - at + len(new)
        found.append((kind, size - len(new), size))
        at = end
    return "".join([*out, text[at:]]), found


def plain_numbers(words: list[str], chance: random.Random) -> str:
    """Words with numbers between them that are nobody's data: years, amounts, dates, times, versions."""

    def number() -> str:
        a, b = chance.randrange(1, 1000), chance.randrange(1, 60)
        forms = (a, 1900 + b, f"{b}.{b % 10}", f"{b},{a:03d}", f"{b}-{b + 2}", f"20{b % 30:02d}-0{b % 9 + 1}-1{b % 10}", f"{b % 24}:{b:02d}")
        return str(chance.choice([*forms, f"{b}.", f"{a},", f"({a})", f"{a}{b}00", f"{b}%", f"v{b}.{a % 10}.{b % 7}"]))

    return "".join(f" {w} {number()}" for w in words)


# --- the field -----------------------------------------------------------------------------------

LABELS = 1 + len(FIELD_KINDS)


@dataclass(frozen=True)
class Field:
    """Weights of the features for each label, and of label pairs along the chain and over skips."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def _merge(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, int]:
    """All features, all edges (chain first) of many graphs as one, and the number of chain edges."""
    offsets = np.cumsum([0, *(len(g.places) for g in graphs)])
    chain = [(a + o, b + o) for g, o in zip(graphs, offsets.tolist()) for a, b in g.chain]
    skip = [(a + o, b + o) for g, o in zip(graphs, offsets.tolist()) for a, b in g.skip]
    features = np.concatenate([g.features for g in graphs]) if graphs else np.zeros((0, FEATURES), dtype=np.float32)
    return features.astype(np.float64), np.array(chain + skip, dtype=int).reshape(-1, 2), len(chain)


def propagate(field: Field, features: np.ndarray, edges: np.ndarray, chains: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tokens and of the edges by loopy sum-product message passing, half damped."""
    unary = features @ field.unary
    pair = np.empty((len(edges), LABELS, LABELS))
    pair[:chains], pair[chains:] = field.chain, (field.skip + field.skip.T) / 2
    a, b = edges[:, 0], edges[:, 1]
    forward, back = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
    belief = unary.copy()
    for _ in range(sweeps if len(edges) else 0):
        to_b = _sum_exp((belief[a] - back)[:, :, None] + pair, 1)
        to_a = _sum_exp((belief[b] - forward)[:, None, :] + pair, 2)
        forward = 0.5 * forward + 0.5 * (to_b - to_b.max(axis=1, keepdims=True))
        back = 0.5 * back + 0.5 * (to_a - to_a.max(axis=1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, b, forward)
        np.add.at(belief, a, back)
    marginal = np.exp(belief - _sum_exp(belief, 1)[:, None]) if len(belief) else belief
    joint = (belief[a] - back)[:, :, None] + (belief[b] - forward)[:, None, :] + pair
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if len(edges) else joint
    return marginal, joint / joint.sum(axis=(1, 2), keepdims=True) if len(edges) else joint


def fit_field(graphs: list[Graph], labels: np.ndarray, s: Settings) -> Field:
    """Weights that maximise the likelihood of the known labels, its gradient taken from the propagated marginals.

    Tokens with an unknown label pass messages like all others and pull at no weight.
    """
    features, edges, chains = _merge(graphs)
    sizes = (FEATURES * LABELS, LABELS * LABELS, LABELS * LABELS)
    w, first, second = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    known = labels != UNKNOWN
    target = np.eye(LABELS)[np.maximum(labels, 0)]
    both = known[edges[:, 0]] & known[edges[:, 1]] if len(edges) else np.zeros(0, dtype=bool)
    paired = target[edges[:, 0]][:, :, None] * target[edges[:, 1]][:, None, :] if len(edges) else np.zeros((0, LABELS, LABELS))

    def field(w: np.ndarray) -> Field:
        u, c, k = np.split(w, np.cumsum(sizes)[:2])
        return Field(u.reshape(FEATURES, LABELS), c.reshape(LABELS, LABELS), k.reshape(LABELS, LABELS))

    for step in range(1, s.steps + 1 if len(labels) else 0):
        marginal, joint = propagate(field(w), features, edges, chains, s.sweeps)
        rest = (paired - joint) * both[:, None, None]
        skips = rest[chains:].sum(axis=0)
        g = np.concatenate([(features.T @ ((target - marginal) * known[:, None])).ravel(), rest[:chains].sum(axis=0).ravel(), ((skips + skips.T) / 2).ravel()])
        g = g / len(labels) - s.l2 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return field(w)


def further_spans(text: str, graph: Graph, marginal: np.ndarray, spans: list[Span], s: Settings) -> list[Span]:
    """Runs of neighbouring tokens of one certain label, trimmed, that meet no base span."""
    label = np.where(marginal.max(axis=1) >= s.certain, marginal.argmax(axis=1), 0).tolist()
    tied = set(graph.chain)
    taken = sorted((a, b) for _, a, b in spans)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else starts
    found, k = [], 0
    while k < len(label):
        last = k
        while label[k] and (last, last + 1) in tied and label[last + 1] == label[k]:
            last += 1
        if label[k]:
            start, end = graph.places[k][0], graph.places[last][1]
            while start < end and text[start] in _EDGE:
                start += 1
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            before = int(np.searchsorted(starts, end, "left")) - 1 if taken else -1
            if end > start and (before < 0 or reach[before] <= start):
                found.append((label[k] - 1, start, end))
        k = last + 1
    return found


# --- Spark ---------------------------------------------------------------------------------------


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on a bounded sample of texts with a digit or "@".

    Each text counts twice: as it is, labelled by the base patterns and by keys that follow a cue,
    and rewritten, with its spans in forms that the patterns miss and features that give them
    away hidden at random. So the field learns what such tokens look like and stand next to, not
    the patterns. Tasks send features, labels and edges, no texts. Without such texts all weights are 0.
    """
    held = texts(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]")).withColumn("one", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                chance = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                other, moved = rewritten(text, spans, chance)
                other += plain_numbers([w for w in text.split()[:60] if w.isalpha()][:8], chance)
                for version, of in ((text, spans), (other, moved)):
                    g = build(version, s)
                    labels = silver(g, of, version)
                    if version is other and len(g.features):
                        hide = np.random.default_rng(chance.getrandbits(32)).random((len(g.features), len(GIVEAWAY))) < s.hidden
                        g.features[:, GIVEAWAY] *= ~hide
                    rows.append([x.tobytes() for x in (g.features, *(np.array(v, dtype=np.int32) for v in (labels, g.chain, g.skip)))])
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["features", "labels", "chain", "skip"])

    sample = bounded_sample(held, "doc_id", s.fit_rows, "one").select("text")
    rows = sample.mapInArrow(run, "features binary, labels binary, chain binary, skip binary").collect()
    rows.sort(key=lambda r: tuple(map(bytes, r)))
    graphs, labels = [], []
    for r in rows:
        features = np.frombuffer(r["features"], dtype=np.float32).reshape(-1, FEATURES)
        chain, skip = ([tuple(x) for x in np.frombuffer(r[c], dtype=np.int32).reshape(-1, 2).tolist()] for c in ("chain", "skip"))
        graphs.append(Graph([(0, 0)] * len(features), features, chain, skip))
        labels.append(np.frombuffer(r["labels"], dtype=np.int32))
    return fit_field(graphs, np.concatenate(labels) if labels else np.zeros(0, dtype=int), s)


def graphs_of(found: list[str], s: Settings) -> Iterator[tuple[list[str], list[Graph]]]:
    """Texts with their graphs, up to a number of tokens at a time."""
    part, graphs, tokens = [], [], 0
    for text in found:
        part.append(text)
        graphs.append(build(text, s))
        tokens += len(graphs[-1].places)
        if tokens >= s.batch_tokens or len(part) == 1024:
            yield part, graphs
            part, graphs, tokens = [], [], 0
    if part:
        yield part, graphs


def find(docs: DataFrame, field: Field, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added of every row: arrays of (kind, start, end) by kind and start, in code points.

    ``base`` holds the matches of the patterns, ``added`` what the field finds besides, of the same
    kinds or ``secret``: tokens with a digit or "@" whose marginal is certain after messages have passed between neighbours
    and between repeated or similar tokens anywhere in the text. Each such token is tied to the
    one before it with the same key, so a text has as many edges as tokens at most. Null and
    empty texts have no spans; ids may be null or repeat; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def told(spans: list[Span]) -> list[dict]:
        return [{"kind": FIELD_KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            base, added = [], []
            for part, graphs in graphs_of(found, s):
                features, edges, chains = _merge(graphs)
                marginal, _ = propagate(held.value, features, edges, chains, s.sweeps)
                done = 0
                for text, graph in zip(part, graphs):
                    spans = base_spans(text) if graph.places else []
                    own = marginal[done : done + len(graph.places)]
                    done += len(graph.places)
                    base.append(told(spans))
                    added.append(told(further_spans(text, graph, own, spans, s)) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], ["doc_id", "base", "added"]
            )

    kind = "array<struct<kind:string,start:long,end:long>>"
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {kind}, added {kind}")
