import random

import numpy as np
import pyarrow as pa
import pytest

from curaspark.llm import near_dup as nd

SCHEMA = "rec string, text string, id int, key int"


def _records(n=120, seed=1, longest=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = rng.choices(vocabulary, k=rng.randint(8, longest))
        rows.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 12 * longest // 60)):
                at = rng.randrange(len(copy))
                what = rng.random()
                if what < 0.4:
                    copy[at] = rng.choice(vocabulary)
                elif what < 0.7:
                    copy.insert(at, rng.choice(vocabulary))
                else:
                    copy.append(copy.pop(at))
            rows.append(copy)
    return [(f"r-{k}", " ".join(w).title() if k % 5 else ", ".join(w), 1, 2) for k, w in enumerate(rows)]


def _brute(rows, threshold):
    counts = [(r[0], nd.occurrences(r[1])) for r in rows]
    return {tuple(sorted((a, b))) for i, (a, x) in enumerate(counts) for b, y in counts[i + 1 :] if nd.similarity(x, y) >= threshold}


@pytest.mark.parametrize("limits, n, longest", [((40_000, 20_000), 120, 60), ((40_000, 20_000), 40, 420), ((2, 1), 5, 60), ((1, 2), 4, 420)])
def test_pairs_equal_brute_force(spark, limits, n, longest):
    rows = _records(n, longest=longest)  # small limits: every larger bucket is cut into nodes
    got = [tuple(r) for r in nd.near_pairs(spark.createDataFrame(rows, SCHEMA), limits=limits).collect()]
    want = _brute(rows, nd.THRESHOLD)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)
    high = {p for p in want if p in _brute(rows, 0.8)}
    assert high <= set(got)


def test_nulls_copies_and_empty(spark):
    rows = [("a", "One two TWO", 1, 1), ("b", "two, one two", 1, 1), ("c", None, 1, 1), ("d", " ", 1, 1), ("e", "!!", 1, 1), ("f", "x" * 50000, 1, 1), ("g", "one two", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in nd.near_pairs(df).collect()} == {("a", "b")}
    groups = {r["rec"]: (r["grp"], r["n_links"]) for r in nd.groups(df).collect()}
    assert groups["a"] == ("a", 1) and groups["b"] == ("a", 1) and groups["c"] == ("c", 0) and groups["g"] == ("g", 0)
    assert nd.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nd.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_components(spark):
    rows = _records(60, 2)
    pairs = _brute(rows, nd.THRESHOLD)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["rec"]: r for r in nd.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v["grp"] for k, v in got.items()} == {k: find(k) for k in root}
    assert all(v["n_links"] == sum(k in p for p in pairs) for k, v in got.items())


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_trie_join_finds_all_within_budget(monkeypatch, leaf):
    monkeypatch.setattr(nd, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2, (40, 128))
    bits = np.concatenate([base, base ^ (rng.random((40, 128)) < 0.05), base])
    signature = np.packbits(bits.astype(np.uint8).reshape(-1, 64), axis=1).view(">u8").astype(np.uint64).reshape(len(bits), 2)
    order = np.lexsort((signature[:, 1], signature[:, 0]))
    signature, bits = signature[order], bits[order]
    size = rng.integers(20, 60, len(bits))
    side = np.full(len(bits), -1)
    a, b = nd.trie_join(signature, size, side, np.array([0]), np.array([len(bits)]), 0.7)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    limit = lambda i, j: nd.budget(np.array([size[i] + size[j]]), 0.7)[0]
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] != bits[j]).sum() <= limit(i, j) and min(size[i], size[j]) >= 0.7 * max(size[i], size[j]) - 1e-9}
    assert got == want and len(a) == len(got)


def test_signatures_never_exceed_the_difference():
    hashes = nd._Hashes()
    texts = [r[1] for r in _records(40, 3)]
    tokens, sizes = nd.members(texts, hashes)
    signature = nd.signatures(tokens, sizes)
    for i in range(0, len(texts) - 1):
        a, b = nd.occurrences(texts[i]), nd.occurrences(texts[i + 1])
        apart = ((a - b) + (b - a)).total()
        assert np.bitwise_count(signature[i] ^ signature[i + 1]).sum() <= apart


def test_signatures_fold():
    tokens, sizes = nd.members([r[1] for r in _records(20, 4)], nd._Hashes())
    assert (nd.folded(nd.signatures(tokens, sizes, 256)) == nd.signatures(tokens, sizes, 128)).all()
    assert nd.steps_of(np.array([1, 96, 97, 192, 193, 5000])).tolist() == [0, 0, 1, 1, 2, 3]


def test_a_large_bucket_streams_as_nodes():
    rng = np.random.default_rng(3)
    n = 30_000
    raw = sorted(rng.bytes(16) for _ in range(n))
    table = pa.table({"key": pa.array([5] * n), "step": pa.array([0] * n, type=pa.int8()), "id": pa.array(range(n)), "sig": pa.array(raw, type=pa.binary()), "n": pa.array([30] * n, type=pa.int32())})
    other = pa.table({"key": pa.array([9, 9]), "step": pa.array([0, 0], type=pa.int8()), "id": pa.array([n, n + 1]), "sig": pa.array([raw[0], raw[0]], type=pa.binary()), "n": pa.array([30, 30], type=pa.int32())})
    batches = [b.combine_chunks().to_batches()[0] for b in (table.slice(k, 1000) for k in range(0, n, 1000))] + other.to_batches()
    met = pa.Table.from_batches(list(nd._join_buckets(0.7, (4000, 2000))(iter(batches))))
    kind = met.column("kind").to_numpy()
    assert (kind == nd.NODE_ROW).sum() == n  # each row of the bucket leaves once
    nodes = len(set(met.filter(pa.array(kind == nd.NODE_ROW)).column("node").to_pylist()))
    assert 15 <= nodes <= 17 and (kind == nd.NODES).sum() <= nodes * (nodes + 1) // 2
    assert [(r["key"], r["id"]) for r in met.filter(pa.array(kind == nd.PAIR)).to_pylist()] == [(n, n + 1)]


def test_nodes_with_far_prefixes_do_not_meet():
    nodes = nd._Nodes(1, 10)
    rows = [bytes([b]) * 16 for b in (0, 255)]
    list(nodes.add(pa.table({"key": [1] * 20, "step": pa.array([0] * 20, type=pa.int8()), "id": list(range(20)), "sig": pa.array([rows[0]] * 10 + [rows[1]] * 10, type=pa.binary()), "n": pa.array([20] * 20, type=pa.int32())})))
    assert [(r["node"], r["other"]) for r in nodes.pairs(0.7).to_pylist()] == [(0, 0), (1, 1)]
