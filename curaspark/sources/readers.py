"""Readers of JSON lines, CSV and Parquet with declared schemas, and path helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.functions.text import clean_post, post_id
from curaspark.storage import exists

POSTS = T.StructType([T.StructField("posts", T.ArrayType(T.StructType([T.StructField("com", T.StringType()), T.StructField("perspectives", T.MapType(T.StringType(), T.DoubleType()))])))])
PERSONAS = T.StructType([T.StructField("persona", T.StringType())])
_STRINGS = ["model", "persona", "persona_id", "group", "sentiment", "text", "refusal_reason", "finish_reason"]
_LONGS = ["task_id", "input_tokens", "output_tokens"]
COMPLETIONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField(n, T.LongType()) for n in _LONGS]
    + [T.StructField("toxicity", T.DoubleType()), T.StructField("generation_time", T.DoubleType()), T.StructField("is_refused", T.BooleanType())]
)


def resolve(path: str, base: str | None = None, spark: SparkSession | None = None) -> str:
    """The path as it is if it exists, else below ``base``. With a session, on the file system that the path names."""
    there = os.path.exists(path) if spark is None or base is None else exists(spark, path)
    return path if base is None or there else os.path.join(base, path)


def derived_path(path: str, suffix: str) -> str:
    """``name.jsonl`` -> ``name_suffix.jsonl``."""
    stem, dot, end = path.rpartition(".jsonl")
    return f"{stem}_{suffix}.jsonl{end}" if dot else f"{path}_{suffix}"


def lines_with_ordinal(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value``: lines of a file or folder, numbered from 0 in the order of file names and lines.

    A scan packs parts of files by size, so its own order is none. Lines are counted by part of a file; a part's lines
    come in order, from the position in the scan.
    """
    part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", part.alias("__part"), F.monotonically_increasing_id().alias("__mid"))
    sizes = lines.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part of a file
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    placed = lines.join(F.broadcast(offsets), "__part")
    return placed.select((F.col("__offset") + F.col("__mid") - F.col("__first")).alias("ord"), "value")


def read_threads(spark: SparkSession, path: str, first_lines: int | None = None) -> DataFrame:
    """``ord, posts``: one thread a line; malformed lines are skipped; ``first_lines`` counts lines, 0 or None means all."""
    lines = lines_with_ordinal(spark, path) if first_lines else spark.read.text(path).withColumn("ord", F.lit(None).cast("long"))
    if first_lines:
        lines = lines.where(F.col("ord") < first_lines)
    parsed = lines.withColumn("j", F.from_json("value", T.StructType([*POSTS, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("j is not null and j._bad is null").select("ord", "j.posts")


def posts_of(threads: DataFrame, min_toxicity: float = 0.7, min_length: int = 500) -> DataFrame:
    """``post_id, cleaned_post, perspectives``: posts with both fields, above the toxicity and, cleaned, above the length, strictly.

    A missing toxicity is 0. Cheap tests come before cleaning.
    """
    posts = threads.select(F.explode("posts").alias("p")).select("p.com", "p.perspectives").where("com is not null and perspectives is not null")
    toxic = posts.where(F.coalesce(F.try_element_at("perspectives", F.lit("TOXICITY")), F.lit(0.0)) > min_toxicity)
    return toxic.select(post_id(F.col("com")).alias("post_id"), clean_post(F.col("com")).alias("cleaned_post"), "perspectives").where(F.length("cleaned_post") > min_length)


def described(posts: DataFrame, personas: DataFrame) -> DataFrame:
    """Posts with the persona written for them; those without or with an empty one vanish."""
    return posts.join(personas.select("post_id", "persona"), "post_id").where(F.col("persona") != "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, first: int | None = None) -> DataFrame:
    """Strict JSON lines: a bad or blank line raises. ``first`` takes that many lines, 0 none, None all."""
    lines = spark.read.text(path) if first is None else lines_with_ordinal(spark, path).where(F.col("ord") < first)
    filled = F.when(F.trim("value") != "", F.col("value")).otherwise(F.raise_error(F.lit("blank line in " + path)))
    return lines.select(F.from_json(filled, schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def read_models(spark: SparkSession, base: str, models: list[str], name: str, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """The file of each model's folder with a ``model`` column, and the models found; missing files are skipped."""
    found = [m for m in models if exists(spark, f"{base}/{m}/{name}")]
    if not found:
        return spark.createDataFrame([], T.StructType([f for f in schema if f.name != "model"])).withColumn("model", F.lit(None).cast("string")), []
    own = T.StructType([f for f in schema if f.name != "model"])
    rows = spark.read.schema(own).json([f"{base}/{m}/{name}" for m in found])
    return rows.withColumn("model", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)), found


def model_counts(rows: DataFrame, models: list[str]) -> DataFrame:
    """``model, n, found``: rows read of each model that was asked for; of one without a file 0."""
    asked = rows.sparkSession.createDataFrame([(m,) for m in models], "model string")
    counted = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counted, "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("found"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).schema(schema).csv(path)


def read_embeddings(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame | None:
    """A cached table of vectors, or None if there is none; a wrong number of rows raises."""
    if not exists(spark, path):
        return None
    cached = spark.read.parquet(path)
    if expected is not None and (n := cached.count()) != expected:
        raise ValueError(f"the cache has {n} vectors, expected {expected}")
    return cached
