"""Packing against the tokenizer, a plain quadratic programme and small odd tables."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mektup.llm import packing
from mektup.llm.queries import pack, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check_pieces(rows, texts, tokenizer, window=4096):
    """Each id in one piece, sequences gapless and within the window; returns the share of padding."""
    ids = {k: tokenizer.encode(v or "", add_special_tokens=False).ids + [2] for k, v in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            part = np.array(ids[doc][at : at + p["length"]], dtype="<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids[doc])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_documents(spark, folder, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert check_pieces(pack(spark, folder).collect(), texts, tokenizer) < 0.01


def test_odd_texts(spark, tokenizer):
    odd = [
        None, "", " ", "İstanbul ÎI ŉ ſ ß ẞ", "école <|endoftext|> x", "a'll b'VE 'S 12_3 __ --",
        "日本語のテキスト。 次", "\x0b\x0c\x85 x", "word " * 30_000, "A. " * 9_000, "ΑΣ ΟΔΟΣ", "µ ª º", "\x1c\x1d|",
    ]
    rows = [(i, t, 7, "y") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long, offset string").coalesce(1)
    costs = packing.Costs(plan=20_000)
    found = packing.pack(docs, tokenizer_path(), costs).collect()
    check_pieces(found, dict(enumerate(odd)), tokenizer)


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c."), (5, "c.")], "doc_id long, text string").coalesce(1)
    found = packing.pack(docs, tokenizer_path()).collect()
    assert {r["doc_tokens"] for r in found} == {3} and sum(r["length"] for r in found) == 9
    assert sum(r["length"] for r in found if r["doc_id"] == 5) == 6
    assert packing.pack(docs.where("false"), tokenizer_path()).collect() == []


def test_cuts_are_cheapest():
    chance = random.Random(3)
    for _ in range(60):
        window = 10
        places = np.cumsum([chance.randint(1, window) for _ in range(chance.randint(1, 14))])
        penalties = np.array([chance.choice([0.0, 2.0, 5.0]) for _ in places])
        penalties[-1] = 0.0

        def cost(chosen):
            total, at = 0.0, 0
            for i in chosen:
                total += window - (places[i] - at) + penalties[i]
                at = places[i]
            return total

        best = [0.0] + [float("inf")] * len(places)
        spots = [0, *places]
        for j in range(1, len(spots)):
            for i in range(j):
                if spots[j] - spots[i] <= window:
                    best[j] = min(best[j], best[i] + window - (spots[j] - spots[i]) + penalties[j - 1])
        assert cost(packing.cuts(places, penalties, window)) == pytest.approx(best[-1])


def test_power_sizes():
    costs = packing.Costs()
    assert packing.power_sizes(4096, costs) == [4096]
    assert packing.power_sizes(4090, costs) == [4090]
    assert packing.power_sizes(1536, costs) == [1024, 512]


def test_merger_gives_the_ids_of_the_tokenizer(tokenizer):
    chance = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzàâçèéêëîïñóôöùûüßœž0123456789.,;:!?'*#%&$()-_"
    pieces = ["".join(chance.choice(letters) for _ in range(chance.randint(1, 24))) for _ in range(20_000)]
    coder = packing.Encoder(tokenizer_path())
    assert coder.merger is not None
    found = coder.ids(pieces)
    want = tokenizer.encode_batch(pieces, add_special_tokens=False)
    assert [x.tolist() for x in found] == [x.ids for x in want]
