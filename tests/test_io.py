import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark import storage
from curaspark.operators.relational import not_refused
from curaspark.sources import catalog, readers, sinks
from curaspark.streaming.labels import ingest_labels, read_votes


def _lines(path, rows):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_threads(spark, tmp_path):
    long = "x" * 501
    rows = [
        {"posts": [{"com": long, "perspectives": {"TOXICITY": 0.70001}}, {"com": long, "perspectives": {"TOXICITY": 0.7}}, {"com": long, "perspectives": {"OTHER": 1.0}}, {"perspectives": {"TOXICITY": 0.9}}, {"com": long}]},
        "not json\n",
        {"other": 1},
        {"posts": [{"com": "y" * 500, "perspectives": {"TOXICITY": 0.9}}, {"com": '<span class="quote">q</span>' + "z" * 501, "perspectives": {"TOXICITY": 0.9}}]},
    ]
    path = _lines(tmp_path / "t.ndjson", rows)
    posts = readers.posts_of(readers.read_threads(spark, path)).collect()
    assert sorted(r["cleaned_post"][0] for r in posts) == ["x", "z"]
    assert readers.posts_of(readers.read_threads(spark, path, 2)).count() == 1  # lines count, not posts
    assert readers.read_threads(spark, path, 0).count() == readers.read_threads(spark, path).count() == 3
    written = spark.createDataFrame([(r["post_id"], "p" if r["cleaned_post"][0] == "x" else "") for r in posts], "post_id string, persona string")
    assert readers.described(spark.createDataFrame(posts), written).count() == 1


def test_jsonl(spark, tmp_path):
    path = _lines(tmp_path / "p.jsonl", [{"persona": f"p{k}"} for k in range(20)])
    assert [r["persona"] for r in readers.read_jsonl(spark, path, readers.PERSONAS, 3).collect()] == ["p0", "p1", "p2"]
    assert readers.read_jsonl(spark, path, readers.PERSONAS, 0).count() == 0 and readers.read_jsonl(spark, path, readers.PERSONAS).count() == 20
    bad = _lines(tmp_path / "bad.jsonl", [{"persona": "a"}, "{broken\n"])
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad, readers.PERSONAS).collect()
    numbered = readers.lines_with_ordinal(spark, path).collect()
    assert [json.loads(r["value"])["persona"] for r in sorted(numbered)] == [f"p{k}" for k in range(20)]


def test_models(spark, tmp_path):
    for m in ("one", "two"):
        (tmp_path / m).mkdir()
        _lines(tmp_path / m / "speech.jsonl", [{"text": m, "is_refused": m == "two"}, {"text": None}])
    rows, found = readers.read_models(spark, str(tmp_path), ["one", "two", "gone"], "speech.jsonl", readers.COMPLETIONS)
    assert found == ["one", "two"] and {(r["model"], r["text"]) for r in rows.collect()} == {("one", "one"), ("one", None), ("two", "two"), ("two", None)}
    assert not_refused(rows).count() == 3
    none, found = readers.read_models(spark, str(tmp_path), ["gone"], "speech.jsonl", readers.COMPLETIONS)
    assert none.count() == 0 and not found and "model" in none.columns


def test_csv_embeddings_and_paths(spark, tmp_path):
    (tmp_path / "b.csv").write_text('text,label\n"a ""quoted"", b\nnext",1\nplain,\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "b.csv"), T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])).collect()
    assert rows[0]["text"] == 'a "quoted", b\nnext' and rows[1]["label"] is None
    assert readers.read_embeddings(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "e"))
    assert readers.read_embeddings(spark, str(tmp_path / "e"), 3).count() == 3
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, str(tmp_path / "e"), 4)
    assert readers.resolve("no/such", "/base") == "/base/no/such" and readers.resolve(str(tmp_path), "/base") == str(tmp_path)
    assert readers.derived_path("a/b.jsonl", "clean") == "a/b_clean.jsonl"
    assert catalog.groups(spark).count() == 34 and catalog.sentiments(spark).count() == 2


def test_ranked_and_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü"), (0, None), (1, "b")], "rank int, persona string")
    sinks.write_ranked_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted(os.listdir(tmp_path / "out")) if p.startswith("part") for x in open(tmp_path / "out" / p, encoding="utf-8")]
    assert lines == [{"rank": 0, "persona": None}, {"rank": 1, "persona": "b"}, {"rank": 2, "persona": "ü"}]
    sinks.write_sidecar(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["n"] == 3
    sinks.append_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_overwrite_and_stages(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    sinks.overwrite_in_place(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2
    store = sinks.StagedResults(spark, str(tmp_path / "s"), "k")
    assert store.read() is None
    store.append(spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"), 0)
    store.append(spark.createDataFrame([(2, "b")], "k long, v string"), 1)
    store.append(spark.createDataFrame([(2, "c")], "k long, v string"), 1)
    assert {(r["k"], r["v"]) for r in store.read().collect()} == {(1, "a"), (2, "c")}
    store.compact(str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_label_stream(spark, tmp_path):
    incoming, results, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(incoming)

    def put(name, item, verdicts):
        with open(f"{incoming}/{name}.json", "w", encoding="utf-8") as f:
            for k, v in enumerate(verdicts):
                f.write(json.dumps({"original_idx": item, "judge": f"j{k}", "is_hate": v, "raw": ""}) + "\n")

    put("a", 1, [True] * 4)
    ingest_labels(spark, incoming, results, state).awaitTermination()
    put("b", 1, [False] * 4)
    put("c", 2, [False] * 4)
    ingest_labels(spark, incoming, results, state).awaitTermination()
    put("d", 3, [True] * 2)
    ingest_labels(spark, incoming, results, state).awaitTermination()
    with open(f"{incoming}/e.json", "w", encoding="utf-8") as f:  # the other judges of item 3 come later
        for k in (2, 3):
            f.write(json.dumps({"original_idx": 3, "judge": f"j{k}", "is_hate": True, "raw": ""}) + "\n")
    ingest_labels(spark, incoming, results, state).awaitTermination()
    got = {r["original_idx"]: (r["vote_label"], r["total_votes"]) for r in read_votes(spark, results).collect()}
    assert got == {1: (True, 4), 2: (False, 4), 3: (True, 4)}


def test_order_of_files_and_blank_lines(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.txt").write_text("".join(f"a{k}\n" for k in range(3)))
    (folder / "b.txt").write_text("".join(f"b{k}\n" for k in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r["value"] for r in sorted(readers.lines_with_ordinal(spark, f"file://{folder}").collect())]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{k}" for k in range(3)] + [f"b{k}" for k in range(2000)]
    path = _lines(tmp_path / "blank.jsonl", [{"persona": "a"}, "  \n", {"persona": "b"}])
    for first in (None, 3):
        with pytest.raises(Exception, match="blank line"):
            readers.read_jsonl(spark, path, readers.PERSONAS, first).collect()
    assert readers.read_jsonl(spark, path, readers.PERSONAS, 1).count() == 1


def test_shared_file_systems(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}"
    (tmp_path / "one").mkdir()
    _lines(tmp_path / "one" / "speech.jsonl", [{"text": "x"}])
    rows, found = readers.read_models(spark, base, ["one", "gone"], "speech.jsonl", readers.COMPLETIONS)
    assert found == ["one"] and {tuple(r) for r in readers.model_counts(rows, ["one", "gone"]).collect()} == {("one", 1, True), ("gone", 0, False)}
    spark.range(4).write.parquet(f"{base}/t")
    sinks.overwrite_in_place(spark.read.parquet(f"{base}/t").where("id > 2"), f"{base}/t")
    assert spark.read.parquet(f"{base}/t").count() == 1
    store = sinks.StagedResults(spark, f"{base}/s", "k")
    store.append(spark.createDataFrame([(1, "a")], "k long, v string"), 0)
    assert store.read().count() == 1
    sinks.write_embeddings(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>"), f"{base}/e", "vec_id", "embedding")
    assert readers.read_embeddings(spark, f"{base}/e", 1).first()["embedding"] == [0.5, 1.0]
    sinks.write_metrics(spark.createDataFrame([("b", 1.5), ("a", None)], "dataset string, f1 double"), f"{base}/m")
    assert json.loads(spark.read.text(f"{base}/m").first()["value"]) == [{"dataset": "a", "f1": None}, {"dataset": "b", "f1": 1.5}]


def test_intermediates(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            applicationId = "x"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(RuntimeError):
        storage.shared_dir(Elsewhere)
    kept = storage.materialize(spark.range(3), "some")
    assert kept.count() == 3 and storage.exists(spark, kept._stored_at)
    storage.release(kept, spark.range(1), None)
    assert not storage.exists(spark, kept._stored_at)
