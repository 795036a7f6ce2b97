"""Queries of samples, votes, metrics, statistics, ids and vectors over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.functions import vectors as V
from curaspark.operators import diversity, metrics, relational, sampling, similarity, stats, votes
from curaspark.plans.common import deliveries, register, speech, sql_list, table
from curaspark.plans.text_queries import _VERDICTS_SQL, JUDGES, LABELED, SPEECH_SQL, sql_soft, sql_strip, verdicts
from curaspark.sources.catalog import GROUPS, SENTIMENTS

COMPARED, NEAR, CAP = "all_7_models_voting", 0.3, 1000


def _norm_sql(x: str) -> str:
    return f"coalesce(nullif(lower({sql_strip(x)}), ''), 'unknown')"


def _norm(column: str) -> F.Column:
    from curaspark.functions.text import ustrip

    plain = F.lower(ustrip(F.col(column)))
    return F.when(F.coalesce(plain, F.lit("")) == "", "unknown").otherwise(plain)


# One row an item: the last labelling; equal rows are the same.
_LAST_SQL = f"""(SELECT original_idx, m.g AS grp, m.v AS vote_label FROM (SELECT original_idx, max(struct_pack(t := labeled_at, g := {_norm_sql('"group"')}, v := coalesce(vote_label, false))) AS m
 FROM {LABELED} GROUP BY original_idx))"""


def _last(spark, folder):
    row = F.struct("labeled_at", _norm("group").alias("g"), F.coalesce("vote_label", F.lit(False)).alias("v"))
    last = table(spark, folder, LABELED).groupBy("original_idx").agg(F.max(row).alias("m"))
    return last.select("original_idx", F.col("m.g").alias("group"), F.col("m.v").alias("vote_label"))


_COUNTS_SQL = f"(SELECT grp, count(*) FILTER (vote_label) AS n_hate, count(*) FILTER (NOT vote_label) AS n_other FROM {_LAST_SQL} GROUP BY grp)"
_BALANCED_SQL = f"""SELECT original_idx, grp, CAST(hate AS INTEGER) AS split_label FROM (
 SELECT original_idx, grp, vote_label AS hate, row_number() OVER (PARTITION BY grp, vote_label ORDER BY md5('42|' || original_idx), original_idx) AS r, least(n_hate, n_other, {CAP}) AS n
 FROM {_LAST_SQL} JOIN {_COUNTS_SQL} USING (grp)) WHERE r <= n"""


@register(_BALANCED_SQL)
def balanced_sample(spark, folder):
    taken = sampling.balanced_sample(_last(spark, folder), F.col("group"), F.col("vote_label"), "original_idx", CAP)
    return taken.select("original_idx", "grp", "split_label")


@register(f"SELECT grp, n_hate, n_other, least(n_hate, n_other, {CAP}) AS taken, n_hate < {CAP} AS short FROM {_COUNTS_SQL}")
def balanced_counts(spark, folder):
    return sampling.balanced_counts(_last(spark, folder), F.col("group"), F.col("vote_label"), CAP)


@register(
    f"""SELECT coalesce(grp, 'TOTAL') AS grp, CAST(sum(n_hate) AS BIGINT) AS n_hate, CAST(sum(n_other) AS BIGINT) AS n_other, CAST(sum(least(n_hate, n_other, {CAP})) AS BIGINT) AS taken
 FROM {_COUNTS_SQL} GROUP BY ROLLUP (grp)"""
)
def balanced_totals(spark, folder):
    return sampling.balanced_totals(balanced_counts(spark, folder))


_TRAIN_SQL = "(SELECT DISTINCT original_idx, split_label, model FROM personahate_train_balanced_6judge)"


def _train(spark, folder):
    return relational.label_or_split(table(spark, folder, "personahate_train_balanced_6judge").select("original_idx", "split_label", "model").distinct())


@register(
    f"""SELECT original_idx, split_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(split_label = 1, false) ORDER BY md5('42|' || original_idx), original_idx) AS r,
 count(*) OVER () AS total FROM {_TRAIN_SQL}) WHERE total <= 400 OR r <= 200"""
)
def balanced_downsample(spark, folder):
    return sampling.balanced_downsample(_train(spark, folder), "label", "original_idx", 400).select("original_idx", "label")


@register(
    f"""SELECT original_idx, split_label AS label, CASE WHEN r <= ceil(n / 10) THEN 'test' ELSE 'train' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY split_label ORDER BY md5('42|' || original_idx), original_idx) AS r, count(*) OVER (PARTITION BY split_label) AS n FROM {_TRAIN_SQL})"""
)
def stratified_split(spark, folder):
    return sampling.stratified_split(_train(spark, folder), "label", "original_idx").select("original_idx", "label", "split")


@register("SELECT vec_id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 50")
def random_select(spark, folder):
    return sampling.random_sample(table(spark, folder, "embeddings"), "vec_id", 50).select("vec_id")


_MAJORITY_SQL = f"""(SELECT original_idx, labeled_at, CASE WHEN count(is_hate) > 0 THEN count(*) FILTER (is_hate) >= 4 END AS vote_label, count(*) FILTER (is_hate) AS hate_votes,
 count(is_hate) AS total_votes FROM {_VERDICTS_SQL} GROUP BY original_idx, labeled_at)"""


def _votes(spark, folder):
    keyed = verdicts(spark, folder).withColumn("key", F.struct("original_idx", "labeled_at"))
    return votes.majority(keyed, "key").select("key.*", "vote_label", "hate_votes", "total_votes")


@register(f"SELECT * FROM {_MAJORITY_SQL}")
def majority_vote(spark, folder):
    return _votes(spark, folder)


@register(
    f"""SELECT count(*) AS total, count(*) FILTER (vote_label) AS hate, count(*) FILTER (NOT vote_label) AS non_hate,
 round_even(count(*) FILTER (vote_label) * 100.0 / nullif(count(*), 0)::DOUBLE, 1) AS hate_pct, round_even(count(*) FILTER (NOT vote_label) * 100.0 / nullif(count(*), 0)::DOUBLE, 1) AS non_hate_pct FROM {_MAJORITY_SQL}"""
)
def vote_label_dist(spark, folder):
    return votes.label_distribution(_votes(spark, folder))


@register(
    f"SELECT judge, count(*) AS n, count(is_hate) AS verdicts, count(*) FILTER (is_hate) AS hate, round_even(count(*) FILTER (is_hate) * 100.0 / count(*)::DOUBLE, 1) AS hate_pct FROM {_VERDICTS_SQL} GROUP BY judge"
)
def judge_rates(spark, folder):
    return votes.judge_rates(verdicts(spark, folder))


@register(
    f"""SELECT original_idx, CASE WHEN count(is_hate) > 0 THEN count(*) FILTER (is_hate) >= 4 END AS vote_label, count(*) FILTER (is_hate) AS hate_votes, count(is_hate) AS total_votes
 FROM {_VERDICTS_SQL} GROUP BY original_idx"""
)
def incremental_judge(spark, folder):
    every = verdicts(spark, folder)
    before, more = every.where("judge <> 'fir'").drop("labeled_at"), every.where("judge = 'fir'").drop("labeled_at")
    return votes.add_judge(table(spark, folder, LABELED), before, more)


@register(
    f"""SELECT original_idx, labeled_at, CASE WHEN seen THEN v.vote_label END AS vote_label, CASE WHEN seen THEN v.hate_votes END AS hate_votes, CASE WHEN seen THEN v.total_votes END AS total_votes FROM
 (SELECT DISTINCT original_idx, labeled_at, coalesce(length({sql_strip('text')}), 0) >= 10 AS seen FROM {LABELED}) LEFT JOIN {_MAJORITY_SQL} v USING (original_idx, labeled_at)"""
)
def vote_abstain(spark, folder):
    key = F.struct("original_idx", "labeled_at").alias("key")
    texts = table(spark, folder, LABELED).select(key, "text").distinct()
    keyed = verdicts(spark, folder).withColumn("key", F.struct("original_idx", "labeled_at"))
    return votes.label_texts(texts, keyed, "key").select("key.*", "vote_label", "hate_votes", "total_votes").distinct()


_WIDE_SQL = ", ".join(f"max(CASE WHEN judge = '{j}' THEN struct_pack(a := is_hate, b := raw) END).a AS judge_{j}, max(CASE WHEN judge = '{j}' THEN struct_pack(a := is_hate, b := raw) END).b AS judge_{j}_raw" for j in JUDGES)


@register(f"SELECT original_idx, labeled_at, {', '.join(f'any_value(judge_{j}) AS judge_{j}, any_value(judge_{j}_raw) AS judge_{j}_raw' for j in JUDGES)} FROM {LABELED} GROUP BY original_idx, labeled_at")
def judges_wide(spark, folder):
    keyed = verdicts(spark, folder).withColumn("key", F.struct("original_idx", "labeled_at"))
    return votes.to_wide(keyed, JUDGES, "key").select("key.*", *[c for j in JUDGES for c in (f"judge_{j}", f"judge_{j}_raw")])


@register(f"SELECT DISTINCT original_idx FROM {LABELED} WHERE original_idx NOT IN (SELECT original_idx FROM {_VERDICTS_SQL} WHERE judge = 'fir' AND raw LIKE 'safe%')")
def missing_judge(spark, folder):
    have = verdicts(spark, folder).where("judge = 'fir' and raw like 'safe%'")
    return relational.missing_judge(have, table(spark, folder, LABELED).select("original_idx").distinct(), "fir")


@register(f"SELECT task_id FROM {SPEECH_SQL} WHERE NOT coalesce(is_refused, false) AND task_id NOT IN (SELECT task_id FROM {LABELED} WHERE task_id IS NOT NULL AND hate_votes IS NOT NULL)")
def resume_anti_join(spark, folder):
    return relational.pending(relational.not_refused(deliveries(spark, folder)).select("task_id").distinct(), table(spark, folder, LABELED).where("hate_votes is not null"), "task_id").select("task_id")


@register(
    f"""WITH done AS (SELECT original_idx, arg_max(struct_pack(v := vote_label, h := hate_votes), struct_pack(t := labeled_at, v := vote_label, h := hate_votes)) AS m FROM {LABELED} WHERE task_id % 3 = 0 GROUP BY original_idx)
 SELECT original_idx, m.v AS vote_label, m.h AS hate_votes FROM done
 UNION ALL SELECT DISTINCT original_idx, vote_label, hate_votes FROM {LABELED} WHERE original_idx NOT IN (SELECT original_idx FROM done)"""
)
def resume_union(spark, folder):
    rows = table(spark, folder, LABELED)
    done = rows.where("task_id % 3 = 0").select("original_idx", "vote_label", "hate_votes", "labeled_at")
    fresh = rows.select("original_idx", "vote_label", "hate_votes").distinct().withColumn("labeled_at", F.lit(None).cast("timestamp_ntz"))
    return relational.resume(done, fresh, "original_idx", ["labeled_at", "vote_label", "hate_votes"]).select("original_idx", "vote_label", "hate_votes")


@register(f"SELECT task_id, model, row_number() OVER (ORDER BY model, task_id) - 1 AS original_idx FROM {SPEECH_SQL} WHERE NOT coalesce(is_refused, false)")
def nonrefused_index(spark, folder):
    return relational.index_not_refused(deliveries(spark, folder).select("task_id", "model", "is_refused").distinct(), ["model", "task_id"]).select("task_id", "model", "original_idx")


@register(
    f"""SELECT id * {len(GROUPS) * len(SENTIMENTS)} + g * {len(SENTIMENTS)} + s AS task_id, CAST(id AS VARCHAR) AS persona_id, persona, ({sql_list(GROUPS)})[g + 1] AS "group", ({sql_list(SENTIMENTS)})[s + 1] AS sentiment
 FROM personas_merged, range({len(GROUPS)}) AS gs(g), range({len(SENTIMENTS)}) AS ss(s)"""
)
def task_grid(spark, folder):
    return relational.task_grid(table(spark, folder, "personas_merged"))


@register(
    """SELECT row_number() OVER (ORDER BY k, o, persona) - 1 AS id, persona, source FROM (
 SELECT 0 AS k, id AS o, persona, 'thread' AS source FROM personas_merged WHERE source = 'thread' UNION ALL SELECT 1, ord, persona, 'personahub' FROM persona_personahub_200k)"""
)
def union_with_ids(spark, folder):
    merged = table(spark, folder, "personas_merged").where("source = 'thread'").select(F.col("id").alias("ord"), "persona")
    return relational.union_with_ids([("thread", merged), ("personahub", table(spark, folder, "persona_personahub_200k"))], "ord", "persona")


@register("SELECT id FROM personas_merged WHERE id < 100")
def prefix_limit(spark, folder):
    return relational.prefix(table(spark, folder, "personas_merged"), "id", 100).select("id")


@register(f"SELECT persona_id, coalesce(persona_id, 'unknown') AS key, count(*) AS n FROM {SPEECH_SQL} GROUP BY persona_id")
def key_coalesce(spark, folder):
    from curaspark.functions.text import key_or_unknown

    counted = deliveries(spark, folder).select("task_id", "persona_id").distinct().groupBy("persona_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("persona_id", key_or_unknown(F.col("persona_id")).alias("key"), "n")


_BENCH_SQL = f"""(SELECT 'voting' AS dataset, item_id, text, CAST(ground_truth AS INTEGER) AS label FROM {COMPARED} WHERE label IS DISTINCT FROM 'offensive'
 UNION ALL SELECT 'davidson', item_id, tweet, CAST(class = 0 AS INTEGER) FROM davidson_labeled_data WHERE class <> 1)"""


def _bench(spark, folder):
    first = metrics.bench_without_offensive(table(spark, folder, COMPARED), "voting")
    second = metrics.bench_three_classes(table(spark, folder, "davidson_labeled_data"), "davidson")
    return first.unionByName(second).where(metrics.valid_text(F.col("text")))


@register(f"SELECT dataset, text, label FROM {_BENCH_SQL} WHERE length({sql_strip('text')}) > 0")
def bench_normalize(spark, folder):
    return _bench(spark, folder)


@register("SELECT 'rated' AS dataset, text, CAST(trunc(output_tokens / 100.0) AS INTEGER) AS label FROM (SELECT DISTINCT task_id, text, output_tokens FROM personas_merged_speech WHERE output_tokens IS NOT NULL)")
def bench_rated(spark, folder):
    rows = speech(spark, folder).select("task_id", "text", (F.col("output_tokens") / 100.0).alias("label")).distinct()
    return metrics.bench_rated(rows, "rated")


def _ratio(a: str, b: str, as_: str) -> str:
    return f"round_even(coalesce(({a}) * 100.0 / nullif({b}, 0)::DOUBLE, 0), 1) AS {as_}"


def _metrics_sql(source: str) -> str:
    return f"""SELECT dataset, samples, n_hate, {_ratio('tp + tn', 'samples', 'accuracy')}, {_ratio('2 * tp', '2 * tp + fp + fn', 'f1')}, {_ratio('tp', 'tp + fp', 'precision')}, {_ratio('tp', 'tp + fn', 'recall')}
 FROM (SELECT dataset, count(*) AS samples, count(*) FILTER (label = 1) AS n_hate, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp,
 count(*) FILTER (label = 1 AND pred <> 1) AS fn, count(*) FILTER (label <> 1 AND pred <> 1) AS tn FROM {source} WHERE pred IS NOT NULL AND label IS NOT NULL GROUP BY dataset)"""


@register(_metrics_sql(f"(SELECT dataset, label, CAST(contains(lower(text), 'ban') OR contains(lower(text), 'shout') AS INTEGER) AS pred FROM {_BENCH_SQL} WHERE length({sql_strip('text')}) > 0)"))
def binary_metrics(spark, folder):
    lowered = F.lower("text")
    return metrics.binary_metrics(_bench(spark, folder).withColumn("pred", (F.contains(lowered, F.lit("ban")) | F.contains(lowered, F.lit("shout"))).cast("int")))


_JUDGED_SQL = "(" + " UNION ALL ".join(f"SELECT '{j}' AS dataset, split_label AS label, CAST(judge_{j} AS INTEGER) AS pred FROM personahate_train_balanced_6judge" for j in JUDGES) + ")"


@register(_metrics_sql(_JUDGED_SQL))
def binary_metrics_valid_only(spark, folder):
    wide = table(spark, folder, "personahate_train_balanced_6judge")
    long = wide.select(F.col("split_label").alias("label"), F.inline(F.array(*[F.struct(F.lit(j).alias("dataset"), F.col(f"judge_{j}").cast("int").alias("pred")) for j in JUDGES])))
    return metrics.binary_metrics(long)


@register("SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] THEN 0 ELSE 1 END AS pred FROM embeddings")
def logit_argmax(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", V.argmax(F.slice("embedding", 1, 2)).alias("pred"))


def _postprocessed(spark, folder, cleaned: bool):
    done = stats.postprocess(deliveries(spark, folder))
    if not cleaned:
        done = done.withColumn("was_cleaned", F.lit(False))  # so texts needn't be trimmed
    return done.select("task_id", "model", "was_refused", "is_refused", "was_cleaned").distinct()


@register(
    f"""SELECT model, count(*) AS total, count(*) FILTER (before) AS originally_refused, count(*) FILTER (NOT before AND reason IS NOT NULL) AS newly_refused,
 count(*) FILTER (NOT before AND reason IS NULL) AS final_success, round_even(count(*) FILTER (before OR reason IS NOT NULL) * 100.0 / count(*)::DOUBLE, 1) AS refuse_pct
 FROM (SELECT model, coalesce(is_refused, false) AS before, {sql_soft('text')} AS reason FROM {SPEECH_SQL}) GROUP BY model"""
)
def postprocess_stats(spark, folder):
    return stats.postprocess_stats(_postprocessed(spark, folder, False)).drop("cleaned")


@register(None)
def postprocess_cleaned(spark, folder):
    return stats.postprocess_stats(_postprocessed(spark, folder, True)).select("model", "cleaned")


@register(
    f"""SELECT model, count(*) AS n, round_even(avg(output_tokens), 1) AS avg_tokens, round_even(avg(length(text)), 1) AS avg_chars,
 round_even(avg(len(list_filter(regexp_split_to_array(text, '[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> ''))), 1) AS avg_words
 FROM {SPEECH_SQL} WHERE NOT coalesce(is_refused, false) GROUP BY model"""
)
def length_stats(spark, folder):
    return stats.length_stats(speech(spark, folder))


@register(
    f"""SELECT model, count(DISTINCT persona_id) AS total_personas, count(DISTINCT "group") AS total_groups, count(*) AS total_tasks, count(*) FILTER (NOT coalesce(is_refused, false)) AS successful_generations,
 count(*) FILTER (is_refused) AS refused_generations, round_even(count(*) FILTER (is_refused) * 100.0 / count(*)::DOUBLE, 1) AS refusal_pct, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
 CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM {SPEECH_SQL} GROUP BY model"""
)
def generation_stats(spark, folder):
    return stats.generation_stats(deliveries(spark, folder).drop("text").distinct())


@register(
    f"""SELECT model, format('{{:,}}', refused) || ' (' || printf('%.1f', round_even(refused * 100.0 / total::DOUBLE, 1)) || '%)' AS shown FROM
 (SELECT model, count(*) FILTER (is_refused) AS refused, count(*) AS total FROM {SPEECH_SQL} GROUP BY model)"""
)
def percent_text(spark, folder):
    return stats.with_percent_text(generation_stats(spark, folder), "refused_generations", "refusal_pct").select("model", "shown")


# Vectors, in double
_VEC_SQL = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_EDGES_SQL = f"(SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cos FROM {_VEC_SQL} a JOIN {_VEC_SQL} b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) > {NEAR})"


@register(f"SELECT vec_id, round_even(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 4) AS total FROM {_VEC_SQL}")
def l2_normalize(spark, folder):
    unit = V.l2_normalize(F.col("embedding"))
    return table(spark, folder, "embeddings").select("vec_id", F.bround(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register(f"SELECT a, b, round_even(cos, 5) AS cos FROM {_EDGES_SQL}")
def cosine_edges(spark, folder):
    edges = similarity.cosine_edges(table(spark, folder, "embeddings"), "vec_id", "embedding", NEAR)
    return edges.select("a", "b", F.bround("cos", 5).alias("cos"))


_KEPT_SQL = f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT a, b FROM {_EDGES_SQL}), ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
 walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
 SELECT ids.r, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE edges.b = ids.vec_id AND list_contains(walk.kept, edges.a)) THEN walk.kept ELSE list_append(walk.kept, ids.vec_id) END FROM walk JOIN ids ON ids.r = walk.r + 1)
 SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM walk ORDER BY r DESC LIMIT 1)"""


@register(_KEPT_SQL)
def greedy_dedup(spark, folder):
    return similarity.greedy_dedup(table(spark, folder, "embeddings"), "vec_id", "embedding", NEAR).select("vec_id")


@register(f"SELECT n, kept, n - kept AS removed, round_even((n - kept) * 100.0 / n::DOUBLE, 1) AS removed_pct FROM (SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM ({_KEPT_SQL})) AS kept)")
def dedup_ratio(spark, folder):
    rows = table(spark, folder, "embeddings")
    return similarity.dedup_ratio(rows, similarity.greedy_dedup(rows, "vec_id", "embedding", NEAR))


_FPS_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT * FROM {_VEC_SQL}),
 walk AS (SELECT 0 AS rank, 0::BIGINT AS id, [0]::BIGINT[] AS done UNION ALL
 SELECT rank + 1, nxt, list_append(done, nxt) FROM (SELECT walk.rank, walk.done, (SELECT arg_max(c.vec_id, (c.d, -c.vec_id)) FROM
 (SELECT v.vec_id, min(list_distance(v.e, p.e)) AS d FROM v, v p WHERE list_contains(walk.done, p.vec_id) GROUP BY v.vec_id) c) AS nxt FROM walk WHERE rank < 9))
 SELECT rank, id FROM walk"""


@register(_FPS_SQL)
def fps_select(spark, folder):
    return diversity.farthest_points(table(spark, folder, "embeddings"), "vec_id", "embedding", 10, 0).select("rank", "id")


@register(None)
def dafps_select(spark, folder):
    return diversity.density_aware_points(table(spark, folder, "embeddings"), "vec_id", "embedding", 20, start=0).select("rank", "id")


_DIVERSE_SQL = f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT a, b FROM {_EDGES_SQL}), ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
 walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
 SELECT ids.r, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE edges.b = ids.vec_id AND list_contains(walk.kept, edges.a)) THEN walk.kept ELSE list_append(walk.kept, ids.vec_id) END FROM walk JOIN ids ON ids.r = walk.r + 1),
 v AS MATERIALIZED (SELECT * FROM {_VEC_SQL} WHERE vec_id IN (SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY r DESC LIMIT 1))),
 picks AS (SELECT 0 AS rank, min(vec_id) AS id, [min(vec_id)]::BIGINT[] AS done FROM v UNION ALL
 SELECT rank + 1, nxt, list_append(done, nxt) FROM (SELECT picks.rank, picks.done, (SELECT arg_max(c.vec_id, (c.d, -c.vec_id)) FROM
 (SELECT v.vec_id, min(list_distance(v.e, p.e)) AS d FROM v, v p WHERE list_contains(picks.done, p.vec_id) GROUP BY v.vec_id) c) AS nxt FROM picks WHERE rank < 19))
 SELECT id AS vec_id, rank FROM picks"""


@register(_DIVERSE_SQL)
def select_diverse(spark, folder):
    return diversity.select_diverse(table(spark, folder, "embeddings"), "vec_id", "embedding", NEAR, 20).select("vec_id", "rank")


_PICKS_SQL = "(SELECT vec_id AS id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) ORDER BY vec_id LIMIT 10)"


def _picks(rows):
    return rows.orderBy("vec_id").limit(10).select(F.col("vec_id").alias("id"))


@register(f"SELECT round_even(max(d), 5) AS fill_distance FROM (SELECT v.vec_id, min(list_distance(v.e, p.e)) AS d FROM {_VEC_SQL} v, {_PICKS_SQL} p GROUP BY v.vec_id)")
def fill_distance(spark, folder):
    rows = table(spark, folder, "embeddings")
    return diversity.fill_distance(rows, "vec_id", "embedding", _picks(rows)).select(F.bround("fill_distance", 5).alias("fill_distance"))


@register(
    f"""WITH v AS MATERIALIZED (SELECT * FROM {_VEC_SQL}), p AS MATERIALIZED {_PICKS_SQL}, d AS MATERIALIZED (SELECT a.vec_id AS i, list_distance(a.e, b.e) AS d FROM v a, v b WHERE a.vec_id NOT IN (SELECT id FROM p)),
 k AS (SELECT i, list_sort(list(d))[11] AS rho FROM d GROUP BY i), m AS (SELECT v.vec_id AS i, min(list_distance(v.e, p.e)) AS least FROM v, p GROUP BY v.vec_id)
 SELECT round_even(max(w * least), 4) AS weighted_fill_distance FROM (SELECT d.i, m.least, count(*) FILTER (d.d <= least(m.least + 1e-6 / 10, k.rho)) AS w FROM d JOIN k USING (i) JOIN m USING (i) GROUP BY d.i, m.least)"""
)
def weighted_fill_distance(spark, folder):
    rows = table(spark, folder, "embeddings")
    return diversity.weighted_fill_distance(rows, "vec_id", "embedding", _picks(rows)).select(F.bround("weighted_fill_distance", 4).alias("weighted_fill_distance"))
