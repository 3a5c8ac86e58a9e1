"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mektup.llm import chat, decontaminate, exact_dedup, jaccard, langid, lexical, packing, pii, quality, repair, runlength, sharding, toxicity
from mektup.llm.common import fold, table
from mektup.session import written

TOKENIZER = "word_bpe_49k.json"
QUALITY_CUT, TOXIC_CUT = 0.3, 0.7


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def personal(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""
    docs = table(spark, folder, "documents")
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(pii.FIELD_KINDS) for x in (kind, k)])
    spans = F.array_sort(
        F.transform(
            F.concat("base", "added"), lambda x: F.struct(order[x["kind"]].alias("order"), *[x[c].alias(c) for c in ("start", "kind", "end")])
        )
    )

    def told(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii.find(docs, pii.fit(docs)).select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def labels_outside(spark: SparkSession, folder: str, column: str, modulus: int, held: int) -> DataFrame:
    """Labels (doc_id, label) of the documents that a model may learn from."""
    return (
        table(spark, folder, "labels")
        .where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held))
        .select("doc_id", F.col(column).alias("label"))
    )


def quality_scores(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """doc_id, key and score of ``docs``, learnt from the labelled ones among them."""
    measured = written(quality.statistics(docs), "quality-statistics")
    return quality.score(measured, quality.fit(measured, labels_outside(spark, folder, "quality", 5, 0)))


def rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(spark, folder, table(spark, folder, "documents")).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, labels_outside(spark, folder, "toxic", 3, 1))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"),
    )


def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the formatted conversations, all read back from the output."""
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    read = chat.read_back(chat.format_log(chat.replay(turns.unionByName(own))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def shard(spark: SparkSession, folder: str) -> DataFrame:
    """Shards 0 to 23 by bytes."""
    return sharding.assign(table(spark, folder, "documents"), shards=24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def near(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"))


def run_length_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = runlength.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults by the hash of their place; a dropped turn stays as a row that is not live."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = F.pmod(F.crc32(place.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        (harm != 0).alias("live"),
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    )


def structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": personal,
    "op2_rule_quality": rule_quality,
    "op3_packing": pack,
    "op4_exact_dedup": exact,
    "op5_decontaminate": leaks,
    "op6_chat_format": chat_format,
    "op7_language": language,
    "op8_toxicity": toxic,
    "op9_sharding": shard,
    "op10_jaccard_join": near,
    "op11_run_length_dedup": run_length_dedup,
    "op12_lexical_search": lexical_search,
    "op13_structure_repair": structure_repair,
}
