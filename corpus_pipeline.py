"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and
returns the columns of documents, the last one the packed pieces. Between stages the
rows are written to the shared folder as Parquet and read again. Defined results in every
stage: null, empty and very long texts are kept unless the stage says otherwise; repeated
rows are treated alike; an empty table gives an empty one; further columns of docs, also
such with names that an operator uses, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, langid, ngram_join, packing, surrogates, toxicity
from fathomline.llm.queries import vocabulary_path
from fathomline.session import discard, materialize, table

#: Toxicity needs trained dictionaries, which SQL cannot express.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, n_chars, row): operators add columns beside the first three, and row holds all the rest."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return docs.select("doc_id", "text", "n_chars", F.struct(*(rest or [F.lit(0)])).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with the present text and number of characters."""
    return found.select(*[F.col(c) if c in ("doc_id", "text", "n_chars") else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a score of 0.5 or more; learned from labels outside the held-out fold.

    Null, empty and wordless texts score below 0.5 and stay, as all do where labels of either kind are missing.
    """
    labels = table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 5, 0)).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return _unpacked(toxicity.score(_packed(docs), model).where("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest id (null ids first), one row of repeated ones.

    Wordless texts are in no group: one row of each (doc_id, text) stays.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    keyed = _packed(docs).withColumn("key", key)
    groups = ngram_join.near_duplicates(keyed.select("key", "text"), "key")
    kept = groups.where("n_shingles = 0 OR key = component_id").select("key").distinct()
    first = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return _unpacked(keyed.join(kept, "key", "left_semi").withColumn("first", first).where("first = 1"), docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts; a text that is nothing else becomes empty and stays."""
    found = decontaminate.remove_spans(decontaminate.find_spans(_packed(docs), table(spark, sf_dir, "benchmark")))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _unpacked(found.withColumn("n_chars", n_chars), docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates of the same form; a listed given name may change its length."""
    done = surrogates.replace_checked(_packed(docs), surrogates.SurrogateParams(surrogates.session_key(spark)))
    return _unpacked(done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens along the curve; null texts count as empty ones."""
    return packing.pack(docs.select("doc_id", "text"), packing.PackParams(tokenizer=vocabulary_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", cut_benchmarks),
    ("pii", replace_pii),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # only what this function has written itself
    return STAGES[-1][1](spark, docs, sf_dir)
