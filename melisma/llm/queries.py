"""The driver's queries for the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import chat, classifier, contamination, jaccard, mixing, packing, phrases, quality, resampling, secrets, sharding, tokens, urls
from melisma.llm.sql import ORACLES
from melisma.llm.text import null_key

#: The URL rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TOKEN_LIMIT = 4096


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _model(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.prefix_counts(docs, _model("piece_bpe_32k.model"))
    n = tokens.n_tokens(F.col("prefix_tokens"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_chats(chat.format_chats(rows))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.read_documents(packing.write_sequences(docs, _model("byte_bpe_50k.json"), end_id=0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs, ["doc_id"])
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels")
    # A page's path names the document that it shows; labels judge that document.
    shown = pages.select("url", F.try_to_number(F.regexp_extract("url", "/(\\d{1,18})", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return urls.judge_urls(pages, shown.join(bad, "doc_id").select("url", "bad"), RULES).select("page_id", "host", "path", "rule", "verdict", "host_n", "host_bad")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, ["doc_id", "lang", "source"], owner=F.col("source"), repository=F.concat(null_key(F.col("source")), F.lit("/"), null_key(F.col("lang"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = F.array(*[F.lit(k) for k in (*secrets.KINDS, "owned")])
    placed = F.transform(F.concat("base", "owned"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(placed)).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"), F.col("n_shared").cast("long").alias("n_shared"), "owners", "repositories",
    )


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classifier.classify(docs, classifier.train(docs, labels))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_sharding, op2_decontamination, op3_token_counts, op4_chat_formatting, op5_ngram_jaccard, op6_token_files, op7_quality_rules, op8_url_filters, op9_source_mix, op10_secret_scan, op11_phrase_mining, op12_quality_classifier, op13_importance_resampling)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
