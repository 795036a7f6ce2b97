"""Refusals applied to raw answers, and statistics of answers by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions import text as T


def postprocess(raw: DataFrame) -> DataFrame:
    """Second refusal check and trimming of answers that weren't refused.

    Adds ``was_refused`` and ``was_cleaned``; ``is_refused``, ``refusal_reason`` and ``text`` are rewritten. A NULL ``is_refused`` is false.
    """
    before = F.coalesce(F.col("is_refused"), F.lit(False))
    reason = T.soft_refusal(F.col("text"))
    checked = raw.withColumn("was_refused", before).withColumn("__reason", F.when(~before, reason))
    refused = F.col("was_refused") | F.col("__reason").isNotNull()
    trimmed = checked.withColumn("__text", F.when(refused, F.col("text")).otherwise(T.trim_reasoning(F.col("text"))))
    return (
        trimmed.withColumn("was_cleaned", F.coalesce(F.length("__text") < F.length("text"), F.lit(False)))
        .withColumn("is_refused", refused)
        .withColumn("refusal_reason", F.coalesce("__reason", "refusal_reason"))
        .withColumn("text", F.col("__text"))
        .drop("__reason", "__text")
    )


def postprocess_stats(done: DataFrame) -> DataFrame:
    """By model: rows, refused before, newly refused, cleaned, successful, and the refusal rate in percent."""
    total = F.count(F.lit(1))
    before = F.count_if(F.col("was_refused"))
    new = F.count_if(F.col("is_refused") & ~F.col("was_refused"))
    return done.groupBy("model").agg(
        total.alias("total"), before.alias("originally_refused"), new.alias("newly_refused"), F.count_if("was_cleaned").alias("cleaned"),
        F.count_if(~F.col("is_refused")).alias("final_success"), F.bround((before + new) * F.lit(100.0) / total, 1).alias("refuse_pct"),
    )


def length_stats(df: DataFrame) -> DataFrame:
    """By model, over answers that weren't refused: rows and mean tokens, characters and words; models without any are absent."""
    kept = df.where(~F.coalesce(F.col("is_refused"), F.lit(False)))
    return kept.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("output_tokens"), 1).alias("avg_tokens"), F.bround(F.avg(F.length("text")), 1).alias("avg_chars"), F.bround(F.avg(T.word_count(F.col("text"))), 1).alias("avg_words")
    )


def generation_stats(df: DataFrame) -> DataFrame:
    """By model: personas, groups, tasks, successes, refusals, refusal rate in percent and token sums. Answers come once."""
    refused = F.count_if(F.coalesce(F.col("is_refused"), F.lit(False)))
    total = F.count(F.lit(1))
    return df.groupBy("model").agg(
        F.countDistinct("persona_id").alias("total_personas"), F.countDistinct("group").alias("total_groups"), total.alias("total_tasks"),
        (total - refused).alias("successful_generations"), refused.alias("refused_generations"), F.bround(refused * F.lit(100.0) / total, 1).alias("refusal_pct"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def with_percent_text(df: DataFrame, number: str, percent: str) -> DataFrame:
    """Adds ``shown``: a count with thousands separators and its percentage with one digit."""
    return df.withColumn("shown", F.format_string("%s (%s%%)", F.format_number(number, 0), F.format_number(percent, 1)))
