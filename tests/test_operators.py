import json

import pytest
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions import scores
from mektup.operators import blocks, curate, evaluate, messages, prepare, split, tfidf
from mektup.sources import mails as mail_io
from mektup.sources.envelopes import read_envelopes

LABELS = [
    "Abonelik/Fatura", "Diğer", "Eğitim/Öğretim", "Güvenlik/Uyarı", "Kişisel", "Pazarlama", "Sağlık",
    "Sosyal Medya", "Spam", "İş/Acil",
]
# Published confusion counts, rows are true labels.
MATRIX = [
    [186, 0, 1, 4, 0, 4, 1, 1, 2, 1], [4, 172, 7, 0, 9, 2, 1, 3, 0, 2], [2, 7, 183, 0, 4, 0, 1, 1, 0, 2],
    [1, 4, 0, 181, 0, 0, 0, 2, 6, 6], [0, 6, 2, 0, 177, 1, 1, 0, 0, 13], [6, 5, 0, 2, 7, 163, 3, 5, 5, 4],
    [1, 5, 1, 1, 1, 0, 185, 0, 0, 6], [0, 0, 0, 16, 3, 3, 0, 173, 2, 3], [1, 0, 0, 5, 2, 8, 1, 4, 179, 0],
    [6, 5, 3, 6, 5, 0, 1, 2, 1, 171],
]


@pytest.fixture(scope="module")
def golden(spark):
    cells = [
        (LABELS[i], LABELS[j], n) for i, row in enumerate(MATRIX) for j, n in enumerate(row) if n
    ]
    rows = spark.createDataFrame(cells, "category string, prediction string, n int")
    rows = rows.select("category", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    return evaluate.pair_counts(rows)


def test_golden_report(golden):
    report = {r["label"]: r for r in evaluate.classification_report(golden).collect()}
    assert [r for r in report][:10] == LABELS
    assert report["accuracy"]["precision"] == report["accuracy"]["support"] == 0.885
    macro = report["macro avg"]
    assert macro["precision"] == pytest.approx(0.8863427991748039)
    assert macro["recall"] == pytest.approx(0.885)
    assert macro["f1"] == pytest.approx(0.8851544868663288)
    assert macro["support"] == 2000
    assert report["Sağlık"]["f1"] == pytest.approx(0.9390862944162437)
    assert report["İş/Acil"]["precision"] == pytest.approx(0.8221153846153846)


def test_golden_confusion(golden):
    rows = evaluate.confusion_pivot(golden).collect()
    assert [[r[label] for label in LABELS] for r in rows] == MATRIX
    top = evaluate.confused_pairs(golden).collect()
    assert [(r["truth"], r["prediction"], r["n"]) for r in top[:4]] == [
        ("Sosyal Medya", "Güvenlik/Uyarı", 16), ("Kişisel", "İş/Acil", 13), ("Diğer", "Kişisel", 9),
        ("Spam", "Pazarlama", 8),
    ]
    assert top[0]["rate"] == pytest.approx(0.08)
    assert [r["n"] for r in top[4:]] == [7, 7, 7, 6, 6, 6]


def test_reports_are_written(golden, spark, tmp_path):
    evaluate.write_reports(str(tmp_path), {"report": evaluate.classification_report(golden)})
    assert spark.read.csv(f"{tmp_path}/report.csv", header=True).count() == 13
    assert spark.read.json(f"{tmp_path}/report.json").count() == 13


def test_csv_source(spark, tmp_path):
    text = (
        "﻿Kategori,Başlık,İçerik,Tarih\r\n"
        'Spam,"Ödül ""hemen""","ilk satır\nikinci, satır",2025-01-02 03:04:05\r\n'
        "Spam,NA,metin,\r\nSpam,konu,null,\r\n,konu,metin,\r\nDiğer,iki kelime,merhaba,\r\n"
        "Diğer,uzun konu burada,yeterince kelime,bozuk\r\n"
    )
    (tmp_path / "in.csv").write_text(text, encoding="utf-8")
    rows = mail_io.read_mail_csv(spark, f"{tmp_path}/in.csv")
    assert rows.columns == ["category", "subject", "body", "created_at"]
    kept = prepare.clean_mails(rows).orderBy("category").collect()
    assert [r["subject"] for r in kept] == ["iki kelime", "uzun konu burada", 'Ödül "hemen"'] or len(kept) == 2
    spam = next(r for r in rows.collect() if r["subject"] and r["subject"].startswith("Ödül"))
    assert spam["body"] == "ilk satır\nikinci, satır"
    assert str(spam["created_at"]) == "2025-01-02 03:04:05"
    assert prepare.load_mails(spark, f"{tmp_path}/in.csv").columns[-1] == "mean_word_length"
    assert prepare.clean_mails(rows, Config(keep_empty=True)).count() == 3
    (tmp_path / "bad.csv").write_text("Kategori,Başlık\nSpam,x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="body"):
        mail_io.read_mail_csv(spark, f"{tmp_path}/bad.csv")


def test_store_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert mail_io.read_or_create_mails(spark, path).count() == 0
    assert mail_io.read_or_create_mails(spark, path).columns == ["category", "subject", "body", "created_at"]


def test_append_keeps_stored_rows(spark):
    schema = "category string, subject string, body string, at int"
    old = spark.createDataFrame([("a", "s", "b", 5), ("a", "s2", None, 6)], schema)
    new = spark.createDataFrame([("z", "s", "b", 1), ("z", "s2", None, 2), ("m", "x", "y", 4), ("n", "x", "y", 3), ("q", None, "s2", 9)], schema)
    out = sorted(tuple(r)[:3] for r in curate.append_mails(old, new, "at").collect())
    assert out == [("a", "s", "b"), ("a", "s2", None), ("n", "x", "y"), ("q", None, "s2")]


def test_keep_first_compares_in_full_where_hashes_cannot_tell(spark, monkeypatch):
    rows = [(k, "s", f"text {k % 7}", k % 3) for k in range(40)] + [(3, "s", "text 3", 0)] * 2 + [(50, None, None, 1), (51, None, None, 1)]
    df = spark.createDataFrame(rows, "mail_id int, subject string, body string, extra int").repartition(4)
    expected = [(k, "s", f"text {k}", k % 3) for k in range(7)] + [(50, None, None, 1)]
    assert sorted(map(tuple, curate.dedupe_keep_first(df, ["mail_id"]).collect()), key=str) == sorted(expected, key=str)
    # all first hashes clash
    real = curate._digests
    monkeypatch.setattr(curate, "_digests", lambda keys: (F.lit(1).cast("long"), real(keys)[1]))
    assert sorted(map(tuple, curate.dedupe_keep_first(df, ["mail_id"]).collect()), key=str) == sorted(expected, key=str)


def test_keep_first_moves_no_text(spark):
    df = spark.createDataFrame([(1, "s", "b"), (2, "s", "b")], "mail_id int, subject string, body string")
    plan = curate.dedupe_keep_first(df, ["mail_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_quota_phases(spark):
    counts = spark.createDataFrame([("a", 0, 5), ("b", 1, 20)], "category string, ord int, n int")
    low = curate.quota_gaps(counts, 10, 30, 4).collect()
    assert [(r["category"], r["gap"], r["to_produce"]) for r in low] == [("a", 5, 4)]
    high = curate.quota_gaps(counts, 5, 22, 4).orderBy("category").collect()
    assert [(r["category"], r["gap"], r["to_produce"]) for r in high] == [("a", 4, 4), ("b", 2, 2)]
    assert curate.quota_gaps(counts, 5, 5, 4).count() == 0


def test_default_dimensions(spark):
    pairs = curate.pair_dim(spark)
    near = {r["other"] for r in curate.confusable_neighbours(pairs).filter("category = 'Kişisel'").collect()}
    assert near == {"İş/Acil", "Diğer"}
    mails = spark.createDataFrame(
        [(1, "Spam", "BEDAVA ödül", "şanslı kişi"), (2, "Spam", "bedava", "resmi dekont")],
        "mail_id long, category string, subject string, body string",
    )
    audit = {r["mail_id"]: r for r in curate.keyword_audit(mails, curate.hint_dim(spark)).collect()}
    assert (audit[1]["include_hits"], audit[1]["avoid_hits"], audit[1]["passes"]) == (3, 0, True)
    assert (audit[2]["include_hits"], audit[2]["avoid_hits"], audit[2]["passes"]) == (1, 2, False)
    hints = spark.createDataFrame([("k", "include", "fırsat"), ("k", "include", "indirim")], "category string, kind string, phrase string")
    loud = spark.createDataFrame(
        [(1, "k", "FIRSAT", "İNDİRİM KUPONU"), (2, "other", "a", "b")], "mail_id long, category string, subject string, body string"
    )
    found = {tuple(r) for r in curate.keyword_audit(loud, hints).collect()}
    assert found == {(1, "k", 2, 0, True), (2, "other", 0, 0, True)}
    assert curate.category_dim(spark).count() == 10


def test_large_lookup_is_salted(spark):
    from mektup.session import lookup_join

    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    dim = spark.createDataFrame([("0", "a"), ("1", "b")], "k string, v string")
    salted = lookup_join(rows, dim, "k", "left", max_rows=1)
    plain = lookup_join(rows, dim, "k", "left")
    assert sorted(map(tuple, salted.select("id", "v").collect()), key=str) == sorted(
        map(tuple, plain.select("id", "v").collect()), key=str
    )


def brute_split(ids_by_class, seed, shares):
    import hashlib

    out = {}
    for label, ids in ids_by_class.items():
        order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        for rank, i in enumerate(order):
            out[i] = "train" if rank < shares[label] else "test"
    return out


def test_split_and_folds_exact(spark):
    groups = {"a": range(0, 700), "b": range(700, 711), "c": range(711, 713), "d": range(713, 714)}
    rows = spark.createDataFrame([(i, c) for c, ids in groups.items() for i in ids], "mail_id long, category string")
    counts = {c: len(ids) for c, ids in groups.items()}
    shares = split.split_quota(counts, 0.2)
    assert sum(shares.values()) == 714 - 143
    want = brute_split(groups, 42, shares)
    got = {r["mail_id"]: r["split"] for r in split.stratified_split(rows).collect()}
    assert got == want
    both = split.split_with_folds(rows).collect()
    assert {r["mail_id"]: r["split"] for r in both} == want
    for label in groups:
        sizes = [sum(r["category"] == label and r["fold"] == f for r in both) for f in range(3)]
        assert sum(sizes) == shares[label] and max(sizes) - min(sizes) <= 1
    folds = split.stratified_folds(rows, 3).collect()
    for label, n in counts.items():
        sizes = [sum(r["category"] == label and r["fold"] == f for r in folds) for f in range(3)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_block_records(spark):
    text = "\n".join([
        "Giriş satırı", "1. **Başlık:** \"İlk konu\"", "**İçerik:** birinci satır", "ikinci satır", "",
        "boşluktan sonra", "2. Başlık: İkinci", "İçerik: gövde", "3. sıradaki", "Başlık: gövdesiz",
        "Başlık: üçüncü", "İçerik: 'son'", "Kategori: Spam",
    ])
    rows = spark.createDataFrame([(1, "Spam", text), (2, "Spam", "hiçbir şey")], "response_id long, category string, text string")
    got = [(r["response_id"], r["record"], r["subject"], r["body"]) for r in blocks.block_records(rows).orderBy("record").collect()]
    assert got == [
        (1, 1, "İlk konu", "birinci satır ikinci satır"), (1, 2, "İkinci", "gövde"), (1, 3, "üçüncü", "son"),
    ]


def test_block_records_take_linear_time():
    import time

    def seconds(n):
        text = "\n".join(["Başlık: konu", "İçerik: ilk"] + ["devam"] * n + ["Başlık: b", "İçerik: c", "Kategori: x"] * n)
        start = time.perf_counter()
        assert len(list(blocks.records(text))) == n + 1
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(64_000) for _ in range(3)) < 12 * min(seconds(16_000) for _ in range(3))


def envelope(i, subject=None, body=None, **content):
    inner = {"Headers": {} if subject is None else {"Subject": subject}, "Body": body or "", **content}
    return {"ID": i, "Content": inner}


def test_decode_messages(spark, tmp_path):
    import base64

    def b64(t):
        return base64.b64encode(t.encode()).decode()

    long_text = "Merhaba, bu çok güzel bir gündür."
    multipart = (
        '--==1\r\nContent-Type: text/plain; charset="utf-8"\r\nContent-Transfer-Encoding: base64\r\n\r\n'
        + b64(long_text) + "\r\n--==1--\r\n"
    )
    rows = [
        envelope("plain", ["Konu"], "düz metin"),
        envelope("q", ["=?utf-8?q?Size_=C3=96zel_100%+?="], "x"),
        envelope("b", [f"=?UTF-8?B?{b64('Günaydın')}?= =?utf-8?b?{b64(' dünya')}?= son"], "x"),
        envelope("latin", ["=?iso-8859-1?q?caf=E9?="], "x"),
        envelope("odd", ["=?koi8-r?q?=C1?="], "x"),
        envelope("text", "dizi değil", "x"),
        envelope("multi", ["m"], multipart),
        envelope("bare", ["m"], b64(long_text)),
        envelope("words", ["m"], "justplainwordsoverlimit"),
        envelope("html", ["m"], "<html><body><p>bir</p>\n <p>iki</p></body></html>"),
        envelope("parts", ["m"], "", MIME={"Parts": [
            {"ContentType": "text/html", "Body": "<p>html</p>"}, {"ContentType": "text/plain", "Body": b64(long_text)}]}),
        envelope("nosubject", None, "gövde"),
        envelope("nobody", ["yalnız konu"], "", Raw={"Data": ""}),
        envelope("raw", ["m"], "", Raw={"Data": "ham veri"}),
        {"ID": "flat", "Subject": ["üstte"], "Body": "içeriksiz"},
        {"ID": "hollow", "Content": {}, "Subject": ["konu"], "Body": "govde metni"},
        {"ID": "late", "Subject": ["konu"], "Body": ""},
        envelope("headers", ["m"], "--==1\r\nContent-Transfer-Encoding: base64\r\n" + "X-Line: 1\r\n" * 20_000 + "--==1--\r\n"),
        envelope("nearly", ["m"], "A" * 120 + " - not base64 any more"),
        {"Content": {"Body": "kimliksiz"}},
    ]
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    got = {r["mail_id"]: (r["subject"], r["body"]) for r in messages.decode_messages(read_envelopes(spark, str(path))).collect()}
    assert got["plain"] == ("Konu", "düz metin")
    assert got["q"][0] == "Size Özel 100%+"
    assert got["b"][0] == "Günaydın dünya son"
    assert got["latin"][0] == "café"
    assert got["odd"][0] == "=?koi8-r?q?=C1?="
    assert got["text"][0] == "dizi değil"
    assert got["multi"][1] == got["bare"][1] == got["parts"][1] == long_text
    assert got["words"][1] == "justplainwordsoverlimit"
    assert got["html"][1] == "bir iki"
    assert got["nosubject"] == ("", "gövde")
    assert got["raw"][1] == "ham veri"
    assert got["flat"] == ("üstte", "içeriksiz")
    assert got["hollow"] == ("konu", "govde metni")
    assert got["late"][0] == "konu" and '"ID":"late"' in got["late"][1] and "{" not in got["late"][1]
    assert got["headers"][1].startswith("--==1") and got["headers"][1].count("X-Line") == 20_000
    assert got["nearly"][1] == "A" * 120 + " - not base64 any more"
    assert len(got) == len(rows) - 1


def test_fill_defaults(spark):
    rows = spark.createDataFrame(
        [("1", "", ""), ("2", "konu", ""), ("3", None, "gövde"), ("4", "a", "b")], "mail_id string, subject string, body string"
    )
    got = {r["mail_id"]: (r["subject"], r["body"]) for r in messages.fill_defaults(rows).collect()}
    assert got == {"2": ("konu", "konu"), "3": ("Test", "gövde"), "4": ("a", "b")}


def test_score_functions(spark):
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.0, 0.0, 0.0],)], "p array<double>")
    got = rows.select(
        scores.argmax_label(F.col("p"), labels).alias("best"),
        scores.top_classes(F.col("p"), labels, 2).alias("top"),
        scores.top_shares(scores.top_classes(F.col("p"), labels, 2)).alias("shares"),
    ).collect()
    assert got[0]["best"] == "a" and [t["label"] for t in got[0]["top"]] == ["a", "b"]
    assert got[0]["shares"] == [0.5, 0.5] and got[1]["shares"] == [0.0, 0.0]
    bands = spark.createDataFrame([(0.49,), (0.5,), (0.69,), (0.7,)], "c double")
    assert [r[0] for r in bands.select(scores.confidence_band(F.col("c"))).collect()] == ["low", "medium", "medium", "high"]


def test_export_tfidf(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "kırmızı elma güzel"), (2, "kırmızı armut güzel"), (3, "yeşil elma kötü"), (4, "")], "mail_id long, text_clean string"
    )
    tfidf.export_tfidf(rows, str(tmp_path), Config(max_df=1.0))
    matrix = spark.read.parquet(f"{tmp_path}/matrix")
    names = spark.read.parquet(f"{tmp_path}/feature_names")
    word = names.filter("feature = 'w:elma'").first()["feature_index"]
    assert {r["mail_id"] for r in matrix.filter(F.col("feature_index") == word).collect()} == {1, 3}
    lengths = matrix.groupBy("mail_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(2.0) for r in lengths) and len(lengths) == 3


def test_most_frequent_terms_by_histograms(spark, monkeypatch):
    import random

    chance = random.Random(6)
    letters = ["a", "b", "ç", "日", "😀", " "]
    terms = sorted({"".join(chance.choices(letters, k=chance.randrange(1, 6))) for _ in range(900)})
    stats = [(t, chance.choice([1, 2, 2, 3, 3, 3, 9, 500, 10**6, 3 * 10**9 + chance.randrange(9)])) for t in terms]
    df = spark.createDataFrame(stats, "term string, cf long")
    ranked = sorted(stats, key=lambda s: (-s[1], s[0]))
    monkeypatch.setattr(tfidf, "CELLS", 5)  # several rounds of narrowing, ties told apart letter by letter
    for cap in (1, 7, 60, 199, len(stats) - 1, len(stats), len(stats) + 5):
        assert sorted(map(tuple, tfidf.most_frequent(df, cap).collect())) == sorted(ranked[:cap])
    assert tfidf.most_frequent(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("fits", [True, False])
def test_vocabulary_equals_counting_everything(spark, monkeypatch, fits):
    import random

    if not fits:
        monkeypatch.setattr(tfidf, "BROADCAST_PARTS", 3)
    chance = random.Random(2)
    words = ["elma", "bir", "ab", "armut", "su", "çok güzel", "x"]
    rows = spark.createDataFrame([(k, " ".join(chance.choices(words, k=chance.randrange(9)))) for k in range(60)], "mail_id int, text_clean string")
    for config in (
        Config(word_features=9, char_features=11, max_df=0.7), Config(word_features=40, char_features=0, word_ngrams=(2, 3), min_df=3),
        Config(word_features=5, char_features=500, word_ngrams=(1, 1), char_ngrams=(4, 6), max_df=1.0),
    ):
        least, most = config.min_df, config.max_df * 60
        stats = [r for r in tfidf.term_stats(rows, config).collect() if least <= r["df"] <= most]
        caps = {"w": config.word_features, "c": config.char_features}
        want = [r for k in tfidf.kinds_of(config) for r in sorted((s for s in stats if s["kind"] == k), key=lambda s: (-s["cf"], s["term"]))[: caps[k]]]
        got = tfidf.vocabulary(rows, config).collect()
        assert sorted((r["kind"], r["term"], r["cf"], r["df"]) for r in got) == sorted(map(tuple, want))
        assert [r["term"] for r in sorted(got, key=lambda r: r["feature_index"])] == [r["term"] for r in sorted(want, key=lambda r: (r["kind"] != "w", r["term"]))]
