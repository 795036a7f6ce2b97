"""Consensus of several annotators' labels by spectral reliability (problem 4).

The *chance-centred agreement matrix* holds, for each pair of annotators, the correlation of their verdicts
over the items both judged: agreement beyond what their own rates of "yes" give by chance, divided by the
overlap count. Its leading eigenvector gives each annotator's reliability. *Power iteration by sparse joins*
multiplies an edge table with a vector table; the unknown diagonal is replaced by the squared reliability
of the round before, so abstaining from self-agreement does not bias the result. Reliability, own rate and
prevalence give each annotator's hit and false-alarm rate and from these the weights of a "yes" and a "no".

All passes over the data are map-side-combined aggregations by verdict pattern or item; what is handed from
round to round has one row per annotator. The iteration ends when no annotator's reliability moves by ``CONVERGED``,
the prevalence when it moves less than ``PREVALENCE_CONVERGED``; a warning says so if that isn't reached.

Defined results: a NULL verdict is an abstention; exact repetitions of a row count once, later labellings of
an item count in addition; an item without verdicts has NULL label; ties are no hate; a judge without
overlap has reliability 0; empty tables give empty results.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.storage import materialize

BLOCKS, STEPS, CONVERGED = 100, 3, 1e-5
PREVALENCE_ROUNDS, PREVALENCE_CONVERGED = 20, 1e-4
CLIP = 0.005


def judge_columns(df: DataFrame) -> list[str]:
    """Columns ``judge_<name>`` of boolean type, sorted."""
    return sorted(f.name for f in df.schema if f.name.startswith("judge_") and f.dataType.simpleString() == "boolean")


def _labellings(labelled: DataFrame, judges: list[str]) -> DataFrame:
    """Distinct labellings of each item; repeated deliveries vanish."""
    return labelled.select("original_idx", "labeled_at", *judges).distinct()


def _patterns(labellings: DataFrame, judges: list[str]) -> DataFrame:
    """Verdict patterns with their counts."""
    return labellings.groupBy(*judges).agg(F.count(F.lit(1)).alias("n"))


def agreement(patterns: DataFrame, judges: list[str]) -> DataFrame:
    """Edges ``a, b, w`` in both directions between different annotators: correlation over their overlap."""
    vote = F.array_compact(F.array(*[F.when(F.col(j).isNotNull(), F.struct(F.lit(j).alias("judge"), F.when(F.col(j), 1.0).otherwise(-1.0).alias("x"))) for j in judges]))
    votes = patterns.select("n", vote.alias("votes"))
    pairs = votes.select("n", F.explode("votes").alias("p"), "votes").select("n", "p", F.explode("votes").alias("q")).where("p.judge <> q.judge")
    n, x, y = F.col("n"), F.col("p.x"), F.col("q.x")
    sums = pairs.groupBy(F.col("p.judge").alias("a"), F.col("q.judge").alias("b")).agg(
        F.sum(n).alias("overlap"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy")
    )
    m = F.col("overlap").cast("double")
    chance = (F.col("sx") / m) * (F.col("sy") / m)
    spread = F.sqrt((1 - F.pow(F.col("sx") / m, 2)) * (1 - F.pow(F.col("sy") / m, 2)))
    return sums.select("a", "b", "overlap", F.when(spread > 0, (F.col("sxy") / m - chance) / spread).otherwise(0.0).alias("w"))


def spectral(edges: DataFrame) -> DataFrame:
    """``judge, reliability``: leading eigenvector scaled by its eigenvalue's root, by power iteration over joins."""
    spark = edges.sparkSession
    vector = {r["a"]: 0.5 for r in edges.select("a").distinct().collect()}  # a row an annotator
    for _ in range(BLOCKS if vector else 0):
        state = spark.createDataFrame([(j, x, x * x, 0.0) for j, x in vector.items()], "judge string, x double, self double, last double")
        for _ in range(STEPS):
            moved = edges.join(F.broadcast(state.select(F.col("judge").alias("b"), F.col("x").alias("xb"))), "b").groupBy(F.col("a").alias("judge")).agg(F.sum(F.col("w") * F.col("xb")).alias("y"))
            state = moved.join(F.broadcast(state), "judge").select("judge", (F.col("y") + F.col("self") * F.col("x")).alias("x"), "self", F.col("x").alias("last"))
        rows = state.select("judge", "x", "last").collect()
        norm, before = math.fsum(r["x"] ** 2 for r in rows), math.fsum(r["last"] ** 2 for r in rows)
        if not norm or not before:
            return spark.createDataFrame([(j, 0.0) for j in vector], "judge string, reliability double")
        eigenvalue = math.fsum(r["x"] * r["last"] for r in rows) / before
        scale = math.sqrt(max(eigenvalue, 0.0) / norm) * (1 if math.fsum(r["x"] for r in rows) >= 0 else -1)
        fresh = {r["judge"]: r["x"] * scale for r in rows}
        moved_by = max(abs(x - vector[j]) for j, x in fresh.items())
        vector = fresh
        if moved_by < CONVERGED:
            break
    else:
        if vector:
            warnings.warn(f"reliabilities still move by {moved_by:.1e}", stacklevel=2)
    return spark.createDataFrame([(j, max(-1.0, min(1.0, x))) for j, x in vector.items()], "judge string, reliability double")


def _weights(judges: dict[str, tuple[float, float]], prevalence: float) -> dict[str, tuple[float, float, float, float]]:
    """Of each judge hit rate, false-alarm rate, weight of yes and weight of no."""
    out = {}
    for name, (reliability, rate) in judges.items():
        gap = reliability * math.sqrt(rate * (1 - rate) / (prevalence * (1 - prevalence)))
        false = min(max(rate - prevalence * gap, CLIP), 1 - CLIP)
        hit = min(max(rate + (1 - prevalence) * gap, CLIP), 1 - CLIP)
        out[name] = (hit, false, math.log(hit / false), math.log((1 - hit) / (1 - false)))
    return out


def _posterior(score: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-score))


def fit(labelled: DataFrame, judges: list[str] | None = None) -> tuple[DataFrame, dict[str, dict], float]:
    """Distinct labellings, each annotator's estimates (one entry per judge column) and the prevalence."""
    judges = judge_columns(labelled) if judges is None else judges
    labellings = materialize(_labellings(labelled, judges), "labellings")
    patterns = materialize(_patterns(labellings, judges), "patterns")
    edges = materialize(agreement(patterns, judges), "agreement")
    n = F.col("n")
    totals = patterns.agg(*[F.sum(F.when(F.col(j).isNotNull(), n)).alias(f"n_{j}") for j in judges], *[F.sum(F.when(F.col(j), n)).alias(f"y_{j}") for j in judges]).first()
    loading = {r["judge"]: r["reliability"] for r in spectral(edges).collect()}  # one row per judge column
    seen = {j: (totals[f"n_{j}"] or 0, totals[f"y_{j}"] or 0) for j in judges}
    base = {j: (loading.get(j, 0.0), min(max(y / m, CLIP), 1 - CLIP) if m else 0.5) for j, (m, y) in seen.items()}
    strength = sum(abs(r) for r, _ in base.values())
    prevalence = sum(abs(r) * q for r, q in base.values()) / strength if strength else 0.5
    prevalence = min(max(prevalence, CLIP), 1 - CLIP)
    judged = F.coalesce(*[F.col(j) for j in judges]).isNotNull() if judges else F.lit(False)

    def mean_posterior(prevalence: float) -> float | None:
        w = _weights(base, prevalence)
        score = F.lit(math.log(prevalence / (1 - prevalence)))
        for j in judges:
            score = score + F.when(F.col(j), w[j][2]).when(~F.col(j), w[j][3]).otherwise(0.0)
        mean = patterns.where(judged).agg((F.sum(n * _posterior(score)) / F.sum(n)).alias("p")).first()["p"]
        return None if mean is None else min(max(mean, CLIP), 1 - CLIP)

    for _ in range(PREVALENCE_ROUNDS):  # the prevalence that reproduces itself; each round extrapolates from two steps
        one = mean_posterior(prevalence)
        two = None if one is None else mean_posterior(one)
        if two is None:
            break
        bend = (two - one) - (one - prevalence)
        fresh = prevalence - (one - prevalence) ** 2 / bend if abs(bend) > 1e-9 else two
        fresh = fresh if CLIP < fresh < 1 - CLIP else two
        moved_by, prevalence = abs(fresh - prevalence), fresh
        if moved_by < PREVALENCE_CONVERGED:
            break
    else:
        warnings.warn(f"the prevalence still moves by {moved_by:.1e}", stacklevel=2)
    w = _weights(base, prevalence)
    estimates = {
        j: {"n_verdicts": seen[j][0], "yes_rate": base[j][1], "reliability": base[j][0], "hit_rate": w[j][0], "false_alarm_rate": w[j][1], "yes": w[j][2], "no": w[j][3]}
        for j in judges
    }
    return labellings, estimates, prevalence


def consensus(labelled: DataFrame, judges: list[str] | None = None) -> DataFrame:
    """``original_idx, is_hate, probability, agreement, chance_corrected, n_verdicts`` of each item.

    ``agreement`` is the share of the item's verdicts that equal its consensus label; ``chance_corrected`` the share of
    agreeing pairs of its verdicts in excess of chance by the overall rate of "yes", at most 1, NULL below two verdicts.
    """
    labellings, estimates, prevalence = fit(labelled, judges)
    yes = sum((F.when(F.col(j), 1).otherwise(0) for j in estimates), F.lit(0))
    no = sum((F.when(~F.col(j), 1).otherwise(0) for j in estimates), F.lit(0))
    score = sum((F.when(F.col(j), e["yes"]).when(~F.col(j), e["no"]).otherwise(0.0) for j, e in estimates.items()), F.lit(0.0))
    items = labellings.groupBy("original_idx").agg(F.sum(score).alias("score"), F.sum(yes).alias("yes"), F.sum(no).alias("no"))
    judged = F.col("yes") + F.col("no")
    total = F.col("score") + F.lit(math.log(prevalence / (1 - prevalence)))
    label = F.when(judged > 0, total > 0)
    given = sum(e["n_verdicts"] for e in estimates.values())
    rate = sum(e["yes_rate"] * e["n_verdicts"] for e in estimates.values()) / given if given else 0.5
    chance = rate**2 + (1 - rate) ** 2
    agreeing = (F.col("yes") * (F.col("yes") - 1) + F.col("no") * (F.col("no") - 1)) / (judged * (judged - 1))
    return items.select(
        "original_idx",
        label.alias("is_hate"),
        F.when(judged > 0, _posterior(total)).alias("probability"),
        F.when(judged > 0, F.when(total > 0, F.col("yes")).otherwise(F.col("no")) / judged).alias("agreement"),
        F.when(judged > 1, (agreeing - F.lit(chance)) / F.lit(1 - chance)).alias("chance_corrected"),
        judged.alias("n_verdicts"),
    )


def reliability(labelled: DataFrame, judges: list[str] | None = None) -> DataFrame:
    """Estimates of each annotator."""
    _, estimates, _ = fit(labelled, judges)
    rows = [(j.removeprefix("judge_"), e["n_verdicts"], e["yes_rate"], e["reliability"], e["hit_rate"], e["false_alarm_rate"]) for j, e in estimates.items()]
    return labelled.sparkSession.createDataFrame(rows, "judge string, n_verdicts long, yes_rate double, reliability double, hit_rate double, false_alarm_rate double")
