"""Queries over the problems' whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import bpe, consensus, langid, leakage, near_dup, packing, pair_defects, subset, target_sample


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _limit(spark: SparkSession, folder: str, name: str) -> int:
    return _table(spark, folder, "run_limits").where(F.col("limit_name") == name).agg(F.max("limit_value")).first()[0]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    hub = _table(spark, folder, "persona_personahub_200k").select(F.concat(F.lit("hub-"), "ord").alias("rec"), F.col("persona").alias("text"))
    merged = _table(spark, folder, "personas_merged").select(F.concat(F.lit("merged-"), "id").alias("rec"), F.col("persona").alias("text"))
    return hub.unionAll(merged)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    voting = _table(spark, folder, "all_7_models_voting").select(F.lit("all_7_models_voting").alias("bench"), "item_id", "text")
    davidson = _table(spark, folder, "davidson_labeled_data").select(F.lit("davidson_labeled_data").alias("bench"), "item_id", F.col("tweet").alias("text"))
    return voting.unionAll(davidson)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "personas_merged_speech_labeled_6judge")


def p1_subset(spark, folder):
    return subset.choose(_table(spark, folder, "persona_personahub_200k"), _limit(spark, folder, "subset_rows"))


def p1_subset_small(spark, folder):
    return subset.choose(_table(spark, folder, "persona_personahub_200k"), _limit(spark, folder, "subset_rows_small"))


def p2_found(spark, folder):
    report = target_sample.report(_labelled(spark, folder), _table(spark, folder, "sample_targets"))
    return report.where("missing > 0").select("group", "is_hate")


def p2_report(spark, folder):
    return target_sample.report(_labelled(spark, folder), _table(spark, folder, "sample_targets"))


def p2_sample(spark, folder):
    return target_sample.sample(_labelled(spark, folder), _table(spark, folder, "sample_targets"))


def p3_found(spark, folder):
    return near_dup.near_pairs(_records(spark, folder))


def p3_groups(spark, folder):
    return near_dup.groups(_records(spark, folder))


def p4_found(spark, folder):
    return consensus.consensus(_labelled(spark, folder)).where("is_hate").select("original_idx")


def p4_consensus(spark, folder):
    return consensus.consensus(_labelled(spark, folder))


def p4_reliability(spark, folder):
    return consensus.reliability(_labelled(spark, folder))


def p5_found(spark, folder):
    return pair_defects.defects(_table(spark, folder, "personas_merged_speech"))


def p6_found(spark, folder):
    return leakage.leaks(_table(spark, folder, "personahate_train_balanced_6judge"), "original_idx", "text", _items(spark, folder))


def p7_ids(spark, folder):
    return bpe.encode(_table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark, folder):
    packed = packing.pack_documents(_table(spark, folder, "documents"), _limit(spark, folder, "pack_tokens"))
    return packed.select("doc_id", "piece", "container")


def p8_containers_short(spark, folder):
    packed = packing.pack_documents(_table(spark, folder, "documents"), _limit(spark, folder, "pack_tokens_short"))
    return packed.select("doc_id", "piece", "container")


def p9_found(spark, folder):
    return langid.wrong_labels(_table(spark, folder, "documents"))


def p9_languages(spark, folder):
    return langid.languages(_table(spark, folder, "documents"))


def p9_segments(spark, folder):
    return langid.languages(_table(spark, folder, "documents"), segments=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p1_subset, p1_subset_small, p2_found, p2_report, p2_sample, p3_found, p3_groups, p4_found, p4_consensus, p4_reliability, p5_found,
        p6_found, p7_ids, p8_containers, p8_containers_short, p9_found, p9_languages, p9_segments,
    ]
    return {f.__name__: f for f in found}


_STRIPPED = r"lower(regexp_replace({x}, '^[\s\x{A0}\x{200B}\x{FEFF}]+|[\s\x{A0}\x{200B}\x{FEFF}]+$', '', 'g'))"
_GROUP = "coalesce(nullif(" + _STRIPPED.replace("{x}", '"group"') + ", ''), 'unknown')"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": r"""
WITH rec AS (
  SELECT 'hub-' || ord AS rec, lower(persona) AS t FROM persona_personahub_200k UNION ALL SELECT 'merged-' || id, lower(persona) FROM personas_merged
), word AS (SELECT rec, unnest(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM rec),
occurrence AS (SELECT rec, w, row_number() OVER (PARTITION BY rec, w) AS k FROM word),
size AS (SELECT rec, count(*) AS n FROM occurrence GROUP BY rec),
pair AS (SELECT a.rec AS x, b.rec AS y, count(*) AS common FROM occurrence a JOIN occurrence b ON a.w = b.w AND a.k = b.k AND a.rec < b.rec GROUP BY 1, 2)
SELECT x AS rec_a, y AS rec_b FROM pair JOIN size s ON s.rec = x JOIN size t ON t.rec = y WHERE common / (s.n + t.n - common)::DOUBLE >= 0.7
""",
        "p2_found": f"""
WITH latest AS (
  SELECT original_idx, max(struct_pack(labeled_at := labeled_at, g := {_GROUP}, h := CAST(coalesce(vote_label, false) AS BIGINT))) AS m
  FROM personas_merged_speech_labeled_6judge GROUP BY original_idx
), have AS (SELECT m.g AS g, m.h AS h, count(*) AS n FROM latest GROUP BY 1, 2),
size AS (SELECT floor(count(*) / 10) AS s FROM latest),
cell AS (
  SELECT {_GROUP} AS g, CAST(coalesce(vote_label, false) AS BIGINT) AS h, sum(target_share) AS share, max(min_rows) AS low
  FROM sample_targets GROUP BY 1, 2
)
SELECT cell.g AS "group", cell.h AS is_hate FROM cell CROSS JOIN size LEFT JOIN have ON have.g = cell.g AND have.h = cell.h
WHERE coalesce(n, 0) < greatest(coalesce(low, 0), floor(coalesce(share, 0) * s))
""",
    }
