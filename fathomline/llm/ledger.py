"""Quality rules as a bitmask ledger: every rule is evaluated once, policies read bits.

``measure`` adds the measurements of a whole text, ``ledger`` the failure bits,
``apply_policy`` a verdict under a named, versioned policy, and ``ablation`` the
effect of each rule from one aggregation over distinct masks. All of it is built-in
functions on one row at a time: the main path has no shuffle at all, so a hot source
or a group of copies cannot unbalance it.

Defined results: a null or empty text has no words, zero measurements and fails
``few_words``. Very long texts are measured whole, in one row's arrays of words and window
hashes. Repeated rows are judged separately and alike. Extra columns pass
through; a clash with a measurement's name raises ValueError. An empty table gives
an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_shouted", "n_repeat_words")


@dataclass(frozen=True)
class LedgerParams:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_symbols_per_100_words: int = 20
    min_word_tenths: int = 20
    max_word_tenths: int = 250
    max_dup_line_percent: int = 50
    max_shouted_percent: int = 50


#: Bit i of fail_mask stands for rule i; a new rule takes the next free bit and none is reused.
RULES = ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines", "shouting")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines", "shouting"),
}


def policy_mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def _marked(pairs: Column) -> Column:
    """Starts of windows whose hash stands beside an equal one in the sorted (hash, start) pairs, ascending."""
    beside = F.transform(
        pairs,
        lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]),
    )
    return F.sort_array(F.filter(beside, lambda i: i.isNotNull()))


def _covered(starts: Column, window: int) -> Column:
    """Words covered by windows that begin at the given ascending starts."""
    gaps = F.transform(starts, lambda s, k: F.least(F.coalesce(s - F.get(starts, k - 1), F.lit(window)), F.lit(window)))
    return F.aggregate(gaps, F.lit(0), lambda acc, gap: acc + gap)


def measure(docs: DataFrame, text: str = "text", params: LedgerParams = LedgerParams()) -> DataFrame:
    """Add MEASURES to docs. Windows are compared by 64-bit hashes of their words' 64-bit hashes."""
    clash = {*MEASURES, "_words", "_lines", "_hashes", "_wh", "_pairs", "_starts"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    k, body = params.window, F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_words", F.filter(F.split(body, SPACE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    step = step.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn(
        "_hashes",
        F.when(
            F.size("_wh") > k,
            F.transform(
                F.sequence(F.lit(0), F.size("_wh") - k),
                lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(k)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Each step is a column of its own, so that no lambda evaluates an array again for every element.
    step = step.withColumn(
        "_pairs",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    step = step.withColumn("_starts", F.when(F.col("_pairs").isNotNull(), _marked(F.col("_pairs"))))
    return step.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.endswith("!!"))).cast("long").alias("n_shouted"),
        F.coalesce(_covered(F.col("_starts"), k), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", params: LedgerParams = LedgerParams()) -> DataFrame:
    """docs with MEASURES and ``fail_mask``, one bit for each of RULES."""
    words = F.col("n_words")
    fails = {
        "few_words": words < params.min_words,
        "repeated_windows": 100 * F.col("n_repeat_words") > params.max_repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > params.max_symbols_per_100_words * words,
        "word_length": (words > 0)
        & ((10 * F.col("word_chars") < params.min_word_tenths * words) | (10 * F.col("word_chars") > params.max_word_tenths * words)),
        "duplicate_lines": 100 * F.col("n_dup_lines") > params.max_dup_line_percent * F.col("n_lines"),
        "shouting": 100 * F.col("n_shouted") > params.max_shouted_percent * words,
    }
    mask = F.lit(0)
    for bit, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(fails[rule], F.lit(1 << bit)).otherwise(F.lit(0)))
    return measure(docs, text, params).withColumn("fail_mask", mask)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept`` under the policy and the policy's name; the ledger is not evaluated again."""
    return rows.withColumn("policy", F.lit(policy)).withColumn(
        "kept", F.col("fail_mask").bitwiseAND(F.lit(policy_mask(policy))) == 0
    )


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: failures, failures by it alone, and documents kept without it.

    Counts are first reduced to one row per distinct mask (at most 2 to the number of rules).
    """
    masks = rows.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    whole = policy_mask(policy)
    out = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(1 << RULES.index(rule)).alias("bit"),
        )
        for rule in POLICIES[policy]
    ]
    hit = F.col("fail_mask").bitwiseAND(F.lit(whole))
    return (
        masks.withColumn("r", F.explode(F.array(*out)))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when((hit == 0) | (hit == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
        .withColumn("policy", F.lit(policy))
    )
