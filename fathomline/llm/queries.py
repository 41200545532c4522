"""One query per training-data operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import audit, decontaminate, divergence, langid, ledger, licenses, mixing, ngram_join, packing, sharding, sql, surrogates, toxicity, urlrules
from fathomline.session import table

#: Rules of op9: (host, path, verdict).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = langid.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, labels.where(~held).select("doc_id", "toxic"))
    return (
        toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
        .drop("text")
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )


def op3_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("licenses", 0)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        best["license"].alias("license"),
        best["coverage"].alias("coverage"),
        best["start"].alias("first_word"),
        best["end"].alias("end_word"),
        "licenses",
    )


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_checked(docs, surrogates.SurrogateParams(surrogates.session_key(spark)))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_spans(docs, table(spark, sf_dir, "benchmark")))


def vocabulary_path(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = packing.PackParams(tokenizer=vocabulary_path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), params)


def op8_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 3, 1)
    ranked = langid.fit(docs.where(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), ranked).drop("text")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("n_fitting")


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ledger.apply_policy(ledger.ledger(docs), "v1")
    return rows.selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        f"(fail_mask & {ledger.policy_mask('base')}) <> 0 AS base_failed",
        "kept",
        "fail_mask",
        "policy",
    )


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op10's policy does, from the masks of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger.ablation(ledger.ledger(docs), "v1")


def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_compression_toxicity, op3_patience_licenses, op4_pii_surrogates, op5_label_propagation, op6_fm_decontaminate, op7_hilbert_packing, op8_rank_profiles, op9_url_filter, op10_rule_ledger, op11_filter_shapley, op12_source_mix, op13_source_divergence, ledger_ablation)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": sql.OP1, "op6_fm_decontaminate": sql.OP6, "op9_url_filter": sql.OP9, "op10_rule_ledger": sql.OP10, "op11_filter_shapley": sql.OP11, "op12_source_mix": sql.OP12, "op13_source_divergence": sql.OP13, "ledger_ablation": sql.ABLATION}
