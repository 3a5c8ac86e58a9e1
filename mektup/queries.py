"""Every operator as a named query over the given tables: (spark, folder) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions import scores
from mektup.functions.text import METRIC_NAMES, strip_html
from mektup.operators import bayes, blocks, curate, evaluate, messages, prepare, split, tfidf
from mektup.plans import scoring, training
from mektup.session import fresh_path, scratch_scope, spread, written
from mektup.sources import mails as mail_io
from mektup.sources.envelopes import read_envelopes
from mektup.streaming.watch import first_seen, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORDS_ONLY = Config(char_features=0)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mails(spark: SparkSession, folder: str) -> DataFrame:
    return mail_io.mails_from_documents(spread(table(spark, folder, "documents").select("doc_id", "lang", "text")))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.clean_mails(mails(spark, folder))


def written_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned mails as a written table, for queries that read them more than once."""
    return written(clean(spark, folder).select("mail_id", "category", "text_raw", "text_clean"), "clean")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- cleaning, measures, summaries -----------------------------------------------------------


@query
def clean_text(spark, folder):
    return clean(spark, folder).select("mail_id", "category", "text_clean")


@query
def category_counts(spark, folder):
    return curate.category_counts(clean(spark, folder))


@query
def dataset_summary(spark, folder):
    return curate.dataset_summary(mails(spark, folder))


@query
def labels(spark, folder):
    return prepare.labels(mails(spark, folder))


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.with_metrics(clean(spark, folder)).select("mail_id", "category", *METRIC_NAMES)


@query
def mail_metrics(spark, folder):
    return rounded(measured(spark, folder), 9, "mean_word_length")


@query
def scaled_metrics(spark, folder):
    rows = written(measured(spark, folder), "measures")
    stats = prepare.metric_stats(rows).first().asDict()
    return rounded(prepare.scale_metrics(rows, stats).drop("category"), 6, *METRIC_NAMES)


# --- curation --------------------------------------------------------------------------------


@query
def dedupe_keep_first(spark, folder):
    return curate.dedupe_keep_first(mails(spark, folder), ["mail_id"])


@query
def append_merge(spark, folder):
    rows = mails(spark, folder)
    odd = F.col("mail_id") % 2 == 1
    return curate.append_mails(rows.filter(~odd), rows.filter(odd), order="mail_id")


def language_counts(spark: SparkSession, folder: str) -> DataFrame:
    dim = curate.category_dim(spark, ["de", "en", "es", "fr", "it"])
    return curate.listed_counts(mails(spark, folder), dim)


@query
def listed_counts(spark, folder):
    return language_counts(spark, folder)


def needy_languages(spark: SparkSession, folder: str) -> DataFrame:
    return curate.quota_gaps(language_counts(spark, folder), quota_min=150, quota_max=150, batch=100)


@query
def category_quota(spark, folder):
    return needy_languages(spark, folder)


def mixed_up(spark: SparkSession, folder: str) -> DataFrame:
    wrong = rule_pairs(spark, folder).filter(F.col("truth") != F.col("prediction"))
    return wrong.select(F.col("truth").alias("category"), F.col("prediction").alias("other"))


@query
def confusable_neighbours(spark, folder):
    return curate.confusable_neighbours(mixed_up(spark, folder))


@query
def focus_filter(spark, folder):
    needy = needy_languages(spark, folder).select("category", "gap")
    return curate.focus_confusable(needy, mixed_up(spark, folder))


LANGUAGE_HINTS = {
    "en": {"include": ("the", "and"), "avoid": ("ou",)},
    "de": {"include": ("der", "und"), "avoid": ("ß",)},
    "fr": {"include": ("le ", "de "), "avoid": ("é",)},
    "es": {"include": ("los",), "avoid": ("ñ",)},
}


@query
def keyword_audit(spark, folder):
    return curate.keyword_audit(mails(spark, folder), curate.hint_dim(spark, LANGUAGE_HINTS))


# --- n-grams and TF-IDF ----------------------------------------------------------------------


@query
def word_ngrams(spark, folder):
    stats = tfidf.term_stats(clean(spark, folder), WORDS_ONLY)
    return stats.select("term", "cf", "df")


@query
def char_ngrams(spark, folder):
    return tfidf.term_stats(clean(spark, folder), Config(word_features=0)).select("term", "cf", "df")


@query
def vocabulary(spark, folder):
    return rounded(tfidf.vocabulary(written_clean(spark, folder)), 9, "idf")


@query
def feature_names(spark, folder):
    return tfidf.feature_names(tfidf.vocabulary(written_clean(spark, folder)))


@query
def tfidf_word(spark, folder):
    rows = written_clean(spark, folder)
    return rounded(tfidf.tfidf_long(rows, tfidf.fit_tfidf(rows, WORDS_ONLY)), 6, "weight")


@query
def tfidf_dual(spark, folder):
    """Weights of both blocks, condensed to one row per mail."""
    rows = written_clean(spark, folder)
    vectors = tfidf.fit_tfidf(rows).vectors(rows).select("mail_id", F.unwrap_udt("tfidf").alias("v"))
    zipped = F.zip_with("v.values", "v.indices", lambda w, i: w * i)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    return vectors.select(
        "mail_id",
        F.size("v.indices").alias("n_features"),
        F.round(total(F.col("v.values")), 5).alias("weight_sum"),
        F.round(total(zipped), 3).alias("index_sum"),
        F.round(F.array_max("v.values"), 6).alias("weight_max"),
    ).filter("n_features > 0")


# --- splits ----------------------------------------------------------------------------------


@query
def stratified_split(spark, folder):
    rows = written_clean(spark, folder).select("mail_id", "category")
    return split.stratified_split(rows)


@query
def kfold(spark, folder):
    rows = written_clean(spark, folder).select("mail_id", "category")
    return split.stratified_folds(rows, 3)


@query
def class_weights(spark, folder):
    return rounded(split.class_weights(clean(spark, folder)), 9, "weight")


# --- evaluation of rule-based predictions ----------------------------------------------------


def rule(*cases: tuple[str, str], otherwise: str) -> Column:
    chain = F
    for pattern, label in cases:
        chain = chain.when(F.col("text_clean").rlike(pattern), label)
    return chain.otherwise(otherwise)


def rules() -> dict[str, Column]:
    return {
        "french_only": rule(("[èêçé]", "fr"), otherwise="en"),
        "by_letters": rule(("[ñíó]", "es"), ("[ßäöü]", "de"), ("[èêçé]", "fr"), otherwise="en"),
        "by_words": rule(
            ("(^| )(der|die|und)( |$)", "de"), ("(^| )(los|las|que)( |$)", "es"), otherwise="xx"
        ),
    }


def rule_pairs(spark: SparkSession, folder: str, name: str = "by_letters") -> DataFrame:
    scored = clean(spark, folder).select("category", rules()[name].alias("prediction"))
    # Evaluation reads the counts several times, and each time would clean every text again.
    return written(evaluate.pair_counts(scored), "pairs")


@query
def confusion_long(spark, folder):
    return evaluate.confusion_long(rule_pairs(spark, folder)).select("truth", "prediction", "n")


@query
def confusion_norm(spark, folder):
    dense = evaluate.confusion_long(rule_pairs(spark, folder))
    return rounded(dense.select("truth", "prediction", "share"), 9, "share")


@query
def confusion_pivot(spark, folder):
    return evaluate.confusion_pivot(rule_pairs(spark, folder))


@query
def confused_pairs(spark, folder):
    return rounded(evaluate.confused_pairs(rule_pairs(spark, folder)), 9, "rate")


@query
def classification_report(spark, folder):
    report = evaluate.classification_report(rule_pairs(spark, folder))
    return rounded(report, 9, "precision", "recall", "f1", "support")


SCORES = ("accuracy", "f1_macro", "precision_macro", "recall_macro")


@query
def macro_scores(spark, folder):
    return rounded(evaluate.macro_scores(rule_pairs(spark, folder)), 9, *SCORES)


@query
def class_f1_rank(spark, folder):
    return rounded(evaluate.class_f1_rank(rule_pairs(spark, folder)), 9, "f1")


def rule_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All rules side by side on every mail, counted in one pass."""
    each = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("model"), rule.alias("prediction")) for i, (name, rule) in enumerate(rules().items())]
    )
    scored = clean(spark, folder).select("category", F.inline(each))
    return rounded(evaluate.model_summary(evaluate.model_pairs(scored)), 9, *SCORES)


@query
def model_summary(spark, folder):
    return rule_summary(spark, folder)


@query
def best_model(spark, folder):
    return evaluate.best_model(rule_summary(spark, folder))


@query
def nb_relational(spark, folder):
    rows = written_clean(spark, folder)
    truth = rows.select("mail_id", "category")
    model = tfidf.fit_tfidf(rows, WORDS_ONLY)
    weights = tfidf.tfidf_long(
        rows.withColumn("key", F.struct("mail_id", "category")), model, "key"
    ).select("key.*", "feature_index", "weight")
    features, offsets = bayes.fit_bayes(weights, truth, model.size)
    scored = bayes.score_bayes(weights, truth, features, offsets)
    names = F.array(*[F.lit(c) for c in offsets])
    return scored.select(
        "mail_id", F.inline(F.arrays_zip(names.alias("category"), F.col("scores").alias("score")))
    ).withColumn("score", F.round("score", 4))


# --- scores and probabilities ----------------------------------------------------------------


def class_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding read as decision scores of as many classes as it has dimensions."""
    vectors = table(spark, folder, "embeddings")
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    names = F.transform(
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda i: F.concat(F.lit("class"), F.lpad(i.cast("string"), 2, "0")),
    )
    return vectors.select("vec_id", "label", scores.softmax(doubles).alias("p"), names.alias("labels"))


@query
def softmax_scores(spark, folder):
    return class_probabilities(spark, folder).select(
        "vec_id", F.posexplode("p").alias("cls", "probability")
    ).withColumn("probability", F.round("probability", 9))


@query
def top3_classes(spark, folder):
    top = class_probabilities(spark, folder).select(
        "vec_id", scores.top_classes(F.col("p"), F.col("labels")).alias("top")
    )
    return top.select(
        "vec_id",
        F.posexplode(F.arrays_zip("top", scores.top_shares(F.col("top")).alias("share"))).alias("rank", "t"),
    ).select(
        "vec_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("t.top.label").alias("label"),
        F.round("t.top.probability", 9).alias("probability"),
        F.round("t.share", 9).alias("share"),
    )


@query
def argmax_fallback(spark, folder):
    rows = class_probabilities(spark, folder).withColumn("confidence", F.array_max("p"))
    best = scores.argmax_label(F.col("p"), F.col("labels"))
    return rows.select(
        "vec_id",
        F.round("confidence", 9).alias("confidence"),
        scores.with_fallback(best, F.col("confidence"), 0.02, "Diğer").alias("prediction"),
    )


@query
def confidence_band(spark, folder):
    rows = class_probabilities(spark, folder)
    return rows.select("vec_id", scores.confidence_band(F.array_max("p") * 30).alias("band"))


@query
def expectation_check(spark, folder):
    """The class of every embedding against the one that its scores make likeliest, with the next ones."""
    rows = class_probabilities(spark, folder)
    expected = F.concat(F.lit("class"), F.lpad(F.col("label").cast("string"), 2, "0"))
    scored = rows.select(
        "vec_id",
        expected.alias("expected"),
        scores.argmax_label(F.col("p"), F.col("labels")).alias("prediction"),
        scores.top_classes(F.col("p"), F.col("labels")).alias("top"),
    )
    checked = evaluate.expectation_check(scored)
    told = F.transform("runners_up", lambda t: F.concat_ws(":", t["label"], F.round(t["probability"], 6).cast("decimal(9,6)")))
    return checked.select("vec_id", "expected", "prediction", "hit", F.array_join(told, " ").alias("runners_up"))


# --- raw messages ----------------------------------------------------------------------------


@query
def html_strip(spark, folder):
    return table(spark, folder, "pages").select("page_id", strip_html(F.col("html")).alias("body"))


def _q_word(text: Column) -> Column:
    hexed = F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "=$1")
    return F.concat(F.lit("=?utf-8?q?"), hexed, F.lit("?="))


def _b_word(text: Column) -> Column:
    return F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(text, "UTF-8")), F.lit("?="))


def packed_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed as envelopes, in turn plain, bare base64, multipart and MIME parts."""
    text, first = F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1))
    shape = F.col("doc_id") % 4
    packed = F.base64(F.encode(text, "UTF-8"))
    lines = F.regexp_replace(packed, "(.{76})", "$1\r\n")
    boundary = F.lit("--===============0042==")
    multipart = F.concat(
        boundary,
        F.lit('\r\nContent-Type: text/plain; charset="utf-8"\r\nMIME-Version: 1.0\r\n'),
        F.lit("Content-Transfer-Encoding: base64\r\n\r\n"),
        lines,
        F.lit("\r\n\r\n"),
        boundary,
        F.lit("--\r\n"),
    )
    subject = F.when(shape == 0, first).when(shape == 1, _b_word(first)).otherwise(_q_word(first))
    body = F.when(shape == 0, text).when(shape == 1, packed).when(shape == 2, multipart)
    parts = F.array(
        F.struct(F.lit("text/html").alias("ContentType"), F.lit("<p>unused</p>").alias("Body")),
        F.struct(F.lit("text/plain; charset=utf-8").alias("ContentType"), packed.alias("Body")),
    )
    content = F.struct(
        F.struct(F.array(subject).alias("Subject")).alias("Headers"),
        F.coalesce(body, F.lit("")).alias("Body"),
        F.struct(F.when(body.isNull(), parts).alias("Parts")).alias("MIME"),
    )
    nothing = F.parse_json(F.lit(None).cast("string"))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("doc_id").cast("string").alias("ID"),
        F.lit(None).cast("timestamp").alias("Created"),
        F.parse_json(F.to_json(content)).alias("Content"),
        nothing.alias("Headers"),
        nothing.alias("Subject"),
        F.lit(None).cast("string").alias("Body"),
        nothing.alias("MIME"),
        nothing.alias("Raw"),
    )


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages.decode_messages(packed_envelopes(spark, folder))
    return rows.withColumn("mail_id", F.col("mail_id").cast("long"))


@query
def decode_subjects(spark, folder):
    return decoded(spark, folder).select("mail_id", "subject")


@query
def decode_bodies(spark, folder):
    return decoded(spark, folder).select("mail_id", "body")


@query
def envelope_files(spark, folder):
    """All documents as envelope files: content of its own, none, or an empty one beside the members."""
    shape = F.col("ID").cast("long") % 3

    def member(name: str, kind: str = "variant") -> Column:
        return F.when(shape != 0, F.try_variant_get("Content", f"$.{name}", kind)).alias(name)

    path = fresh_path(spark, "envelopes")
    packed_envelopes(spark, folder).select(
        "ID",
        F.when(shape == 0, F.col("Content")).when(shape == 2, F.parse_json(F.lit("{}"))).alias("Content"),
        member("Headers"),
        member("Body", "string"),
        member("MIME"),
    ).write.json(path)
    rows = messages.decode_messages(read_envelopes(spark, path))
    return rows.withColumn("mail_id", F.col("mail_id").cast("long"))


@query
def default_fill(spark, folder):
    rows = mails(spark, folder).select(
        "mail_id",
        F.when(F.col("mail_id") % 3 == 0, "").otherwise(F.col("subject")).alias("subject"),
        "body",
    )
    return messages.fill_defaults(rows)


@query
def block_records(spark, folder):
    turns = table(spark, folder, "conversations")
    mark = f"{blocks.SUBJECT_MARK}"
    text = F.concat(
        F.lit(f'1. **{mark}:** "'), "role", F.lit(" "), F.col("turn").cast("string"),
        F.lit(f'"\n**{blocks.BODY_MARK}:** '), "text",
        F.lit(f"\n\n2. {mark}: "), F.col("conv_id").cast("string"),
        F.lit(f"\n{blocks.BODY_MARK}: "), "text",
        F.lit(f"\n{blocks.CATEGORY_MARK}: "), "role",
    )
    responses = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"),
        F.col("role").alias("category"),
        text.alias("text"),
    )
    return blocks.block_records(responses)


# --- sources and sinks -----------------------------------------------------------------------


@query
def csv_round_trip(spark, folder):
    """Complete mails written as CSV and read back with the labelled-mail reader."""
    path = fresh_path(spark, "csv")
    rows = mails(spark, folder).dropna()
    mail_io.write_mails(rows, path, "csv")
    return mail_io.read_mail_csv(spark, path).select("mail_id", "category", "subject", "body")


@query
def store_append(spark, folder):
    """Open an empty store, append all mails twice, read back what is stored."""
    path = fresh_path(spark, "store")
    store = mail_io.read_or_create_mails(spark, f"{path}/0")
    rows = mails(spark, folder).select("category", "subject", "body", "mail_id")
    once = written(curate.append_mails(store, rows, "mail_id"), "store")
    return curate.append_mails(once, rows, "mail_id").groupBy("category").agg(F.count("*").alias("n"))


@query
def export_clean_set(spark, folder):
    """The cleaned set written as CSV with raw and clean text and read back: rows and digests by category."""
    with scratch_scope(spark):
        path = fresh_path(spark, "clean-csv")
        mail_io.write_mails(clean(spark, folder).select("mail_id", "category", "subject", "body", "text_raw", "text_clean"), path, "csv")
        back = mail_io.read_mail_csv(spark, path)
        told = back.groupBy("category").agg(
            F.count("*").alias("n"),
            F.sum(F.length("text_raw")).alias("raw_chars"),
            F.sum(F.length("text_clean")).alias("clean_chars"),
            F.sum(F.crc32(F.col("text_clean").cast("binary"))).alias("clean_crc32"),
        )
        # one row for each category
        return spark.createDataFrame(told.collect(), told.schema)


@query
def evaluation_tables(spark, folder):
    """All evaluation tables of a classifier written as CSV; the confusion matrix and the report read back."""
    with scratch_scope(spark):
        path = fresh_path(spark, "evaluation")
        pairs = rule_pairs(spark, folder)
        evaluate.write_reports(
            path,
            {
                "classification_report": evaluate.classification_report(pairs),
                "confusion_matrix_raw": evaluate.confusion_pivot(pairs),
                "confused_pairs": evaluate.confused_pairs(pairs),
            },
        )
        report = spark.read.csv(f"{path}/classification_report.csv", header=True, inferSchema=True)
        matrix = spark.read.csv(f"{path}/confusion_matrix_raw.csv", header=True, inferSchema=True)
        labels = [c for c in matrix.columns if c != "truth"]
        cells = matrix.select("truth", F.inline(F.array(*[F.struct(F.lit(c).alias("prediction"), F.col(c).cast("long").alias("n")) for c in labels])))
        # labels and pairs of labels only
        of_label = report.select(F.col("label").alias("truth"), F.round("f1", 9).alias("f1"))
        told = cells.join(F.broadcast(of_label), "truth")
        return spark.createDataFrame(told.collect(), told.schema)


@query
def export_tfidf(spark, folder):
    """The TF-IDF matrix and its feature names written and read back: mails and weight of every feature."""
    with scratch_scope(spark):
        path = fresh_path(spark, "tfidf")
        tfidf.export_tfidf(written_clean(spark, folder), path)
        names = spark.read.parquet(f"{path}/feature_names")
        told = spark.read.parquet(f"{path}/matrix").groupBy("feature_index").agg(F.count("*").alias("mails"), F.sum("weight").alias("weight"))
        told = names.join(told, "feature_index").select("feature", "mails", F.round("weight", 4).alias("weight"))
        # as many rows as the vocabulary may have terms
        return spark.createDataFrame(told.collect(), told.schema)


@query
def stream_dedupe(spark, folder):
    """All events arriving twice in a stream; each leaves once."""
    source = table(spark, folder, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/events.parquet*")
    both = stream.unionByName(stream)
    path = fresh_path(spark, "stream")
    running = (
        first_seen(both, "event_id")
        .select("event_id", "user_id", "event_type", "value")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out")


# --- training and scoring --------------------------------------------------------------------


def training_set(spark: SparkSession, folder: str) -> training.TrainingSet:
    return training.build_training_set(mails(spark, folder))


def trained(spark: SparkSession, folder: str, name: str) -> training.Trained:
    return training.train_candidate(training_set(spark, folder), name)


def report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return evaluate.classification_report(trained(spark, folder, name).pairs)


@query
def train_report_nb(spark, folder):
    return rounded(report(spark, folder, "Naive Bayes"), 9, "precision", "recall", "f1", "support")


@query
def train_report_lr(spark, folder):
    return report(spark, folder, "Logistic Regression")


@query
def train_report_svm(spark, folder):
    return report(spark, folder, "Linear SVM")


@query
def train_report_gbt(spark, folder):
    return report(spark, folder, "Boosted Trees")


@query
def compare_models(spark, folder):
    """All candidates on the same split, best macro F1 first."""
    return rounded(training.compare_models(mails(spark, folder)).summary, 9, *SCORES)


@query
def feature_importance(spark, folder):
    data = training_set(spark, folder)
    stages = training.fit_logistic(data)
    pipeline = training.PipelineModel(data.feature_stages + stages)
    return training.feature_importance(
        scoring.MailModel("Logistic Regression", data.labels, pipeline, data.config)
    )


@query
def calibrated_probs(spark, folder):
    predictions = trained(spark, folder, "Linear SVM").predictions
    return predictions.select(
        "mail_id", "prediction", F.explode("probabilities").alias("label", "probability")
    )


@query
def svm_certificate(spark, folder):
    """For every fold and class whether its linear machine is at the minimum, recomputed from the long feature table."""
    data = training_set(spark, folder)
    model = training.fit_svm(data)[-1]
    return training.machine_certificate(data, model).select("fold", "category", "rows", "positives", "optimal")


@query
def score_mails(spark, folder):
    """A saved and reloaded model applied to every mail, with fallback below 0.6."""
    path = fresh_path(spark, "artifact")
    scoring.save_artifact(trained(spark, folder, "Naive Bayes").model, path)
    scored = scoring.score(mails(spark, folder), scoring.load_artifact(spark, path), 0.6)
    return scored.select(
        "mail_id",
        "prediction",
        F.round("confidence", 5).alias("confidence"),
        scores.confidence_band(F.col("confidence")).alias("band"),
        F.array_join("top.label", " ").alias("top_labels"),
    )


@query
def stream_score(spark, folder):
    """All documents landing as envelopes, scored once each by the streaming job."""
    path = fresh_path(spark, "watch")
    packed_envelopes(spark, folder).drop("Created").write.option("compression", "gzip").json(f"{path}/landing")
    model = trained(spark, folder, "Naive Bayes").model
    watch(spark, f"{path}/landing", f"{path}/log", f"{path}/checkpoint", model, None).awaitTermination()
    log = spark.read.schema(
        "processed_at timestamp, mail_id string, subject string, body string, prediction string, "
        "probabilities map<string, double>"
    ).json(f"{path}/log")
    shares = F.transform(
        F.array_sort(F.map_entries("probabilities")),
        lambda e: F.concat_ws(":", e["key"], F.round(e["value"], 4).cast("decimal(5,4)")),
    )
    return log.select(
        F.col("mail_id").cast("long").alias("mail_id"), "subject", "body", "prediction", F.array_join(shares, " ").alias("probabilities")
    )
