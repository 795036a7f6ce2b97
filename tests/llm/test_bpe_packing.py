import random
from pathlib import Path

import pytest
import tiktoken

from curaspark.llm import bpe, packing

RAW = Path(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken").read_bytes()
RANKS = bpe.parse_ranks(RAW)
TEXTS = ["", " ", "Hello world, it's 12 o'clock!", "  two  blanks\n\n\tand more ", "naïve café é 東京 👩‍🔧 ​", "a" * 900, "ab" * 700 + "é" * 300, "<|endoftext|> x", "x\x00y﻿", "don't I'll we've THEY'RE"]


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_the_public_library(public):
    encoder = bpe.Encoder(RANKS)
    rng = random.Random(1)
    alphabet = "abcdefghij  \n.,'éßñ東🙂012"
    for text in TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]:
        assert encoder.encode(text) == public.encode_ordinary(text)
        assert encoder.count(text) == len(public.encode_ordinary(text))
    assert encoder.encode(None) == [] and encoder.count(None) == 0


def test_heap_and_scan_agree():
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choices(b"abcde etion\xc3\xa9", k=rng.randint(1, 200)))
        assert bpe.merge_heap(piece, RANKS) == bpe.merge_scan(piece, RANKS)


def test_encode_tables(spark, public):
    rows = [(k, t, 5) for k, t in enumerate(TEXTS)] + [(100, None, 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, "doc_id", "text").collect()}
    assert all(got[k] == public.encode_ordinary(t) for k, t in enumerate(TEXTS)) and got[100] == [] and got[0] == []
    assert all(public.decode(got[k]) == t for k, t in enumerate(TEXTS))
    assert dict(bpe.encode(df, "doc_id", "text").dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert bpe.encode(spark.createDataFrame([], df.schema), "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_plan_respects_capacity_and_places_all(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1000])
    histogram = {rng.randint(0, capacity): rng.randint(1, 300) for _ in range(rng.randint(0, 60))}
    load, placed = {}, dict.fromkeys(histogram, 0)
    for length, start, end, first, each in packing.plan(histogram, capacity):
        assert start == placed[length]
        for r in range(start, end):
            c = first + (r - start) // each
            load[c] = load.get(c, 0) + length
        placed[length] = end
    assert placed == histogram and all(x <= capacity for x in load.values())
    total = sum(n * k for n, k in histogram.items())
    big = sum(k for n, k in histogram.items() if 2 * n > capacity)
    assert len([c for c, x in load.items() if x]) <= max(1.3 * max(-(-total // capacity), big) + 1, 1)


@pytest.mark.parametrize("shard", [200_000, 40])
def test_pack(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard)
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 3, 3, 3, 10, 50, 99, 100, 101, 250, 1000]), 1, 1) for k in range(600)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int, piece int, container int"), 100).collect()
    load, of = {}, {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["length"]
        of.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    assert max(load.values()) <= 100 and set(of) == set(range(600))
    for k, n, *_ in rows:
        pieces = sorted(of[k])
        assert sum(x for _, x in pieces) == n and [p for p, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-n // 100))
    assert sum(load.values()) / (100 * len(load)) > 0.97


def test_pack_documents_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 300, 1)], "doc_id long, text string, length int")
    out = packing.pack_documents(docs, 100).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3} and max(r["piece"] for r in out) >= 2
    assert packing.pack_documents(spark.createDataFrame([], docs.schema), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "doc_id long, n_tokens int"), 0)
