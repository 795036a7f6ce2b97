"""Near-duplicate records with small edits (problem 3).

Similarity is the share of common word occurrences: occurrences in common divided by occurrences in either, so
the Jaccard similarity of the sets of (word, how many-th occurrence).

1. Records with equal word occurrences form one class; only classes are compared.
2. Each class gets a *parity signature*: every (word, occurrence) flips one of its bits. Two signatures never
   differ in more bits than the sets differ in members, and a similarity of ``t`` allows at most
   ``(1-t)/(1+t) * (size_a + size_b)`` of those: this is the Hamming error budget, and it loses no pair. Signatures grow
   with the texts: up to ``SHORT`` members ``BITS`` bits, and twice as many for each doubling (``STEPS`` times). A long
   signature folds into a shorter one by exclusive-or of its halves, so that texts of neighbouring lengths compare.
3. Classes meet in buckets of ``ROWS`` equal min-hashes, in ``BANDS`` bands (a pair at similarity 0.7 meets with
   probability 0.997, at 0.75 with 0.9998).
4. In each bucket a *binary trie self-join* runs over the signatures: pairs of trie nodes are traversed together,
   level by level, differing bits are added up and a pair is pruned when it exceeds the budget of the two nodes' largest
   members. Nodes are ranges of the sorted signatures, so all buckets of a partition advance together in array
   operations; pairs of small nodes have the rest of their path compressed into one exclusive-or.
5. What remains is verified word by word.

Skew: entries move once, sorted by bucket and signature. A bucket of more than ``BUCKET_ROWS`` rows isn't held: as it
streams by, it is cut into nodes of ``NODE_ROWS`` rows that follow each other in the trie; pairs of nodes whose common
prefixes already exceed the budget are dropped, the others are tasks of their own. Classes take copies out before, and
only the requested pair list expands them, large classes in salted blocks. There is no cap on buckets or partners.

Defined results: NULL, blank and wordless records are similar to nothing; identical records are similar; ids are
``hub-<ord>`` and ``merged-<id>``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.session import ship
from curaspark.storage import materialize, release

THRESHOLD = 0.7
SHORT, BITS, STEPS = 96, 128, 3
BANDS, ROWS = 32, 5
BUCKET_ROWS, NODE_ROWS = 40_000, 20_000
CLASS_ROWS = 1000
LEAF = 64
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def occurrences(text: str | None) -> Counter:
    """Word occurrences of the lower-cased text."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Common occurrences divided by occurrences in either."""
    common = (a & b).total()
    return common / (a.total() + b.total() - common) if common else 0.0


class _Hashes(dict):
    """64-bit hash by word, emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def members(texts: list[str], hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed (word, occurrence) members of all texts, and how many each has."""
    flat: list[int] = []
    times: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        seen: dict[str, int] = {}
        words = WORD.findall(text.lower())
        sizes[k] = len(words)
        for w in words:
            n = seen.get(w, 0)
            seen[w] = n + 1
            times.append(n)
        flat += map(hashes.__getitem__, words)
    return _mix(np.array(flat, dtype=np.uint64) + np.array(times, dtype=np.uint64) * _ODD), sizes


def steps_of(sizes: np.ndarray) -> np.ndarray:
    """Doublings of the signature by the number of members."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / SHORT - 1e-12)), 0, STEPS).astype(np.int8)


def signatures(tokens: np.ndarray, sizes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity signatures of unsigned 64-bit words."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (_mix(tokens ^ _ODD) % np.uint64(bits)).astype(np.int64)
    parity = np.bincount(owner * bits + bit, minlength=len(sizes) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, 64), axis=1).view(">u8").astype(np.uint64).reshape(len(sizes), bits // 64)


def folded(signature: np.ndarray) -> np.ndarray:
    """The signature of half as many bits."""
    half = signature.shape[1] // 2
    return signature[:, :half] ^ signature[:, half:]


def band_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bucket of each text in each band; all sizes must be positive."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sizes), BANDS * ROWS), dtype=np.uint64)
    for k in range(0, BANDS * ROWS, ROWS):
        least[:, k : k + ROWS] = np.minimum.reduceat((tokens[:, None] * a[None, k : k + ROWS]) >> np.uint64(24), starts, axis=0)
    keys = np.zeros((len(sizes), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]
    for r in range(ROWS):
        keys = _mix(keys * _ODD + least[:, r::ROWS])
    return keys


def budget(total: np.ndarray, threshold: float) -> np.ndarray:
    """Most members in which two sets of together ``total`` members may differ."""
    return np.floor((1 - threshold) / (1 + threshold) * total + 1e-9).astype(np.int64)


def _range_max(values: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Largest value of each range, none empty."""
    return np.maximum.reduceat(np.append(values, 0), np.stack([a0, a1], axis=1).ravel())[::2]


def trie_join(signature: np.ndarray, size: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group within the Hamming budget of their sizes.

    ``signature`` is sorted within each group ``starts <= row < ends``. Rows with side -1 join with each
    other, rows of side 0 only with rows of side 1.
    """
    bits = 64 * signature.shape[1]
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    a0, a1 = starts.copy(), ends.copy()
    b0, b1, errors = a0.copy(), a1.copy(), np.zeros(len(starts), dtype=np.int64)
    depth = 0
    while len(a0):
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth >= bits)
        if small.any():
            for pa_, pb_ in _leaf_pairs(a0[small], a1[small], b0[small], b1[small]):
                total = size[pa_] + size[pb_]
                near = (np.minimum(size[pa_], size[pb_]) >= threshold * np.maximum(size[pa_], size[pb_]) - 1e-9) & ((side[pa_] < 0) | (side[pa_] != side[pb_]))
                pa_, pb_, total = pa_[near], pb_[near], total[near]
                apart = np.bitwise_count(signature[pa_] ^ signature[pb_]).sum(1, dtype=np.int64)
                near = apart <= budget(total, threshold)
                found_a.append(pa_[near])
                found_b.append(pb_[near])
            a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
            if not len(a0):
                break
        bit = (signature[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the bit turns to 1
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        children = [
            (a0, am, b0, bm, errors),
            (am, a1, bm, b1, errors),
            (a0, am, bm, b1, errors + 1),
            (am[other], a1[other], b0[other], bm[other], errors[other] + 1),
        ]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*children))
        kept = (a1 > a0) & (b1 > b0)
        a0, a1, b0, b1, errors = (x[kept] for x in (a0, a1, b0, b1, errors))
        depth += 1
        if len(a0) and depth % 4 == 0:
            kept = errors <= budget(_range_max(size, a0, a1) + _range_max(size, b0, b1), threshold)
            a0, a1, b0, b1, errors = (x[kept] for x in (a0, a1, b0, b1, errors))
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _leaf_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, chunk: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs of pairs of nodes, each unordered pair of a node with itself once."""
    cells = (a1 - a0) * (b1 - b0)
    upto = np.cumsum(cells)
    at = 0
    while at < len(cells):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, side="right")))
        count = cells[at:end]
        node = np.repeat(np.arange(at, end), count)
        cell = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        width = (b1 - b0)[node]
        a, b = a0[node] + cell // width, b0[node] + cell % width
        twice = (a0[node] == b0[node]) & (a1[node] == b1[node])
        kept = ~twice | (a < b)
        yield a[kept], b[kept]
        at = end


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their class (``rec, id``), and classes with a text of theirs (``id, text``); wordless records have none."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                words = sorted(WORD.findall(text.lower())) if text else []
                keys.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, type=pa.binary()), batch.column(1)], names=["rec", "key", "text"])

    keyed = materialize(records.select("rec", "text").mapInArrow(run, "rec string, key binary, text string").where("key is not null"), "records")
    firsts = keyed.groupBy("key").agg(F.min("rec").alias("rec"))
    chosen = keyed.join(firsts, ["rec", "key"], "left_semi")
    ids = materialize(chosen.dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()), "classes")
    of = materialize(keyed.select("rec", "key").join(ids.select("key", "id"), "key").select("rec", "id"), "members")
    release(keyed)
    return of, ids.select("id", "text")


ENTRY = "key long, step byte, id long, sig binary, n int"


def _entries(texts: DataFrame) -> DataFrame:
    """Bucket entries (``ENTRY``) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens, sizes = members(part.column(1).to_pylist(), hashes)
                steps, keys = steps_of(sizes), band_keys(tokens, sizes)
                ids, owner = part.column(0).to_numpy(), np.repeat(steps, sizes)
                for step in np.unique(steps).tolist():
                    own = steps == step
                    sig = signatures(tokens[owner == step], sizes[own], BITS << step).astype(">u8")
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * sig.shape[1]), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                    rows = np.repeat(np.arange(len(sig)), BANDS)
                    arrays = [pa.array(keys[own].ravel().view(np.int64)), pa.array(np.full(len(rows), step, dtype=np.int8)), pa.array(ids[own][rows]), packed.take(pa.array(rows)), pa.array(sizes[own][rows].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "step", "id", "sig", "n"])

    return texts.mapInArrow(run, ENTRY)


def _signature(column: pa.Array) -> np.ndarray:
    """Rows x 64-bit words of signatures of the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(len(column), -1)


def _solve(group: np.ndarray, step: np.ndarray, side: np.ndarray, ids: np.ndarray, size: np.ndarray, sig: pa.Array, threshold: float) -> np.ndarray:
    """Near pairs of classes (smaller id first) among rows of equal group, of equal or neighbouring steps."""
    by_step = {k: np.flatnonzero(step == k) for k in np.unique(step).tolist()}
    found: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]

    def join(rows: np.ndarray, signature: np.ndarray, sides: np.ndarray) -> None:
        order = np.lexsort((*signature.T[::-1], group[rows]))
        rows, signature, sides = rows[order], signature[order], sides[order]
        of = group[rows]
        new = np.flatnonzero(of[1:] != of[:-1]) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(rows)]])
        several = ends - starts > 1
        a, b = trie_join(signature, size[rows], sides, starts[several], ends[several], threshold)
        low, high = np.minimum(ids[rows[a]], ids[rows[b]]), np.maximum(ids[rows[a]], ids[rows[b]])
        found.append(np.stack([low, high], axis=1)[low != high])

    for k, rows in by_step.items():
        own = _signature(sig.take(pa.array(rows)))
        join(rows, own, side[rows])
        if k + 1 in by_step:
            more = by_step[k + 1]
            both = np.concatenate([rows, more])
            sides = np.repeat([0, 1], [len(rows), len(more)])
            if (side[both] >= 0).any():  # two nodes: each pair has one row of either
                for turn in (0, 1):
                    pick = np.concatenate([rows[side[rows] == turn], more[side[more] == 1 - turn]])
                    if len(pick):
                        joined = np.concatenate([own[side[rows] == turn], folded(_signature(sig.take(pa.array(more[side[more] == 1 - turn]))))]) if (side[more] == 1 - turn).any() else own[side[rows] == turn]
                        join(pick, joined, side[pick])
            else:
                join(both, np.concatenate([own, folded(_signature(sig.take(pa.array(more))))]), sides)
    return np.unique(np.concatenate(found), axis=0)


MET = "kind byte, key long, node int, other int, step byte, id long, sig binary, n int"
PAIR, NODE_ROW, NODES = 0, 1, 2


def _met(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"kind": pa.int8(), "key": pa.int64(), "node": pa.int32(), "other": pa.int32(), "step": pa.int8(), "id": pa.int64(), "sig": pa.binary(), "n": pa.int32()}
    columns["kind"] = pa.array(np.full(rows, kind, dtype=np.int8))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in types.items()], names=list(types))


def _pairs_met(pairs: np.ndarray) -> pa.RecordBatch:
    return _met(PAIR, len(pairs), key=pa.array(pairs[:, 0]), id=pa.array(pairs[:, 1]))


class _Nodes:
    """A large bucket that streams by: its nodes' ends, and the pairs of nodes that may hold near rows."""

    def __init__(self, key: int, rows: int):
        self.key, self.rows = key, rows
        self.step, self.first, self.last, self.most = [], [], [], []

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of the bucket in their order, as rows of nodes."""
        steps, sizes = rows.column("step").to_numpy(), rows.column("n").to_numpy()
        at = 0
        while at < len(steps):
            end = min(at + self.rows, at + int(np.searchsorted(steps[at:], steps[at], side="right")))
            part = rows.slice(at, end - at).combine_chunks()
            node = len(self.step)
            self.step.append(int(steps[at]))
            self.first.append(int.from_bytes(part.column("sig")[0].as_py(), "big"))
            self.last.append(int.from_bytes(part.column("sig")[len(part) - 1].as_py(), "big"))
            self.most.append(int(sizes[at:end].max()))
            for batch in part.to_batches():
                yield _met(NODE_ROW, len(batch), key=batch.column("key"), node=pa.array(np.full(len(batch), node)), step=batch.column("step"), id=batch.column("id"), sig=batch.column("sig"), n=batch.column("n"))
            at = end

    def pairs(self, threshold: float) -> pa.RecordBatch:
        """Pairs of nodes whose common prefixes are within the budget."""
        bits = [BITS << k for k in self.step]
        common = [b - (f ^ x).bit_length() for b, f, x in zip(bits, self.first, self.last)]
        out = []
        for i in range(len(common)):
            for j in range(i, len(common)):
                if self.step[j] > self.step[i] + 1:
                    break
                apart = 0
                if self.step[i] == self.step[j]:
                    both = min(common[i], common[j])
                    apart = ((self.first[i] >> (bits[i] - both)) ^ (self.first[j] >> (bits[j] - both))).bit_count() if both else 0
                if apart <= int(budget(np.array(self.most[i] + self.most[j]), threshold)):
                    out.append((i, j))
        pairs = np.array(out, dtype=np.int32).reshape(-1, 2)
        return _met(NODES, len(pairs), key=pa.array(np.full(len(pairs), self.key)), node=pa.array(pairs[:, 0]), other=pa.array(pairs[:, 1]))


def _join_buckets(threshold: float, limits: tuple[int, int]):
    """Partition sorted by bucket, step and signature -> near pairs of classes, and the nodes of large buckets. ``limits``: rows of a bucket that is held, and of a node."""
    bucket_rows, node_rows = limits

    def solve(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new)
        company = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(company):
            return _pairs_met(np.zeros((0, 2), dtype=np.int64))
        table = table.take(pa.array(company)).combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        return _pairs_met(_solve(group[company], column("step"), np.full(len(company), -1), column("id"), column("n").astype(np.int64), table.column("sig").combine_chunks(), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        large: _Nodes | None = None
        for batch in batches:
            while large is not None and batch.num_rows:
                key = batch.column(0).to_numpy()
                end = int(np.searchsorted(key, large.key, side="right"))
                held.append(batch.slice(0, end))
                rows += end
                if end == len(key) and rows < node_rows:
                    batch = batch.slice(end)
                    break
                yield from large.add(pa.Table.from_batches(held))
                held, rows = [], 0
                if end < len(key):
                    yield large.pairs(threshold)
                    large = None
                batch = batch.slice(end)
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 5 * bucket_rows:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # where the last bucket starts
            if cut:
                yield from parts(table.slice(0, cut))
            table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
            if rows > bucket_rows:
                large = _Nodes(int(key[-1]), node_rows)
                yield from large.add(table)
                held, rows = [], 0
        if large is not None:
            if rows:
                yield from large.add(pa.Table.from_batches(held))
            yield large.pairs(threshold)
        elif rows:
            yield from parts(pa.Table.from_batches(held))

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets: large ones become nodes, the others are joined."""
        key = table.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        at = 0
        for start, size in zip(starts[sizes > bucket_rows].tolist(), sizes[sizes > bucket_rows].tolist()):
            if start > at:
                yield solve(table.slice(at, start - at))
            nodes = _Nodes(int(key[start]), node_rows)
            yield from nodes.add(table.slice(start, size))
            yield nodes.pairs(threshold)
            at = start + size
        if at < len(key):
            yield solve(table.slice(at))

    return run


def _join_nodes(threshold: float):
    """All rows of a pair of nodes -> their near pairs."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        n = table.num_rows
        pairs = _solve(np.zeros(n, dtype=np.int64), column("step"), column("side").astype(np.int64), column("id"), column("n").astype(np.int64), table.column("sig").combine_chunks(), threshold)
        return pa.table({"a": pa.array(pairs[:, 0], type=pa.int64()), "b": pa.array(pairs[:, 1], type=pa.int64())})

    return run


def near_classes(texts: DataFrame, threshold: float = THRESHOLD, limits: tuple[int, int] = (BUCKET_ROWS, NODE_ROWS)) -> DataFrame:
    """``a, b``: pairs of classes (a < b) of at least the threshold's similarity."""
    placed = _entries(texts).repartition("key").sortWithinPartitions("key", "step", "sig")
    met = materialize(placed.mapInArrow(_join_buckets(threshold, limits), MET), "met")
    pairs = met.where(F.col("kind") == PAIR).select(F.col("key").alias("a"), F.col("id").alias("b"))
    rows, nodes = met.where(F.col("kind") == NODE_ROW), met.where(F.col("kind") == NODES).select("key", F.col("node").alias("i"), F.col("other").alias("j"))
    row = ["step", "id", "sig", "n"]
    first = rows.withColumnRenamed("node", "i").drop("other").join(nodes, ["key", "i"]).select("key", "i", "j", F.when(F.col("i") == F.col("j"), -1).otherwise(0).alias("side"), *row)
    second = rows.withColumnRenamed("node", "j").drop("other").join(nodes.where("i <> j"), ["key", "j"]).select("key", "i", "j", F.lit(1).alias("side"), *row)
    large = first.unionAll(second).groupBy("key", "i", "j").applyInArrow(_join_nodes(threshold), "a long, b long")  # 2 NODE_ROWS rows each
    candidates = pairs.unionAll(large).distinct()
    named = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    candidates = candidates.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(occurrences(x), occurrences(y)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, type=pa.bool_()))

    return candidates.mapInArrow(verify, "a long, b long")


def _blocks(of: DataFrame) -> DataFrame:
    """Members of classes with their block: a class of more than ``CLASS_ROWS`` members has several, ``blocks`` of them."""
    sizes = of.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / CLASS_ROWS).cast("int").alias("blocks"))
    return of.join(sizes.where("blocks > 1"), "id", "left").select("id", "rec", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))


def near_pairs(records: DataFrame, threshold: float = THRESHOLD, limits: tuple[int, int] = (BUCKET_ROWS, NODE_ROWS)) -> DataFrame:
    """``rec_a, rec_b``: all pairs of different records of at least the threshold's similarity, equal ones included.

    Pairs of members are made by blocks of their classes, so no class is expanded in one task, and members of classes
    without company don't move.
    """
    of, texts = classes(records)
    links = materialize(near_classes(texts, threshold, limits), "links")
    sizes = of.groupBy("id").agg(F.count(F.lit(1)).alias("members"))
    linked = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).distinct()
    several = sizes.where("members > 1").select("id")
    placed = materialize(_blocks(of.join(linked.unionAll(several).distinct(), "id", "left_semi")), "placed")
    shape = placed.groupBy("id").agg(F.first("blocks").alias("blocks"))
    meet = links.unionAll(shape.select(F.col("id").alias("a"), F.col("id").alias("b")))
    wide = meet.join(shape.select(F.col("id").alias("a"), F.col("blocks").alias("na")), "a").join(shape.select(F.col("id").alias("b"), F.col("blocks").alias("nb")), "b")
    cells = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("a <> b or i <= j")
    first, second = (placed.select(F.col("id").alias(k), F.col("block").alias(n), F.col("rec").alias(r)) for k, n, r in (("a", "i", "x"), ("b", "j", "y")))
    both = cells.select("a", "b", "i", "j").join(first, ["a", "i"]).join(second, ["b", "j"]).where("a <> b or i < j or x < y")
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def components(links: DataFrame) -> DataFrame:
    """``id, component``: connected components of ``a, b``; ids without link are absent. Smallest labels spread over links and shortcuts."""
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(around, "id").select("id", F.col("component").alias("old"), F.least(F.col("component"), F.col("near")).alias("component"))
        jump = moved.join(labels.select(F.col("id").alias("component"), F.col("component").alias("far")), "component", "left")
        fresh = materialize(jump.select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        changed = fresh.where("old <> component").limit(1).count()
        release(labels)
        if not changed:
            release(both)
            return fresh.select("id", "component")
        labels = fresh


def groups(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rec, grp, n_links``: each record with the smallest record of its group, and its number of similar records.

    Groups are the connected components; copies are counted, not expanded. A record without words is alone.
    """
    of, texts = classes(records)
    links = materialize(near_classes(texts, threshold), "links")
    sizes = materialize(of.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("rec").alias("least")), "sizes")
    sided = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    partners = sided.join(sizes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("partners"))
    labelled = sizes.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("least").alias("grp"))
    of_class = labelled.join(least, "component").join(partners, "id", "left").select("id", "grp", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    placed = of.join(of_class, "id").select("rec", "grp", "n_links")
    return records.select("rec").join(placed, "rec", "left").select("rec", F.coalesce("grp", "rec").alias("grp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
