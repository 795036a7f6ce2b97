"""Choosing a varied subset (problem 1).

1. Records with the same words (lower-cased, in order) count once, so copies have no weight. Words are hashed into
   ``BUCKETS`` places; document frequencies cover all texts.
2. *Topical features*: for the ``CORE`` most frequent words, how often two of them share a text is counted over all
   texts. The logarithm of what exceeds chance, damped where little is expected, is small for words that go with
   everything, however frequent, and large for those of one kind of record. The leading eigenvectors of this matrix,
   up to the largest drop between eigenvalues (of ``EIGEN``), are the topical directions; there are as many topics.
3. *Mini-batch k-means* on these features: the texts are split by a hash of their id into ``BATCHES`` batches, all of
   which are used; each batch is summed by centre on the executors, and a centre moves by the batch's share of all
   it has seen, for ``EPOCHS`` epochs or until centres move less than ``STILL``. Centres start by *k-means||*: in each
   of ``ROUNDS`` passes over all texts, each text is drawn with a chance in proportion to its squared distance from
   those drawn before, so any text can open a cluster; the drawn, weighted by how many texts are nearest to each, are
   put together by k-means++.
4. Each topic gets an equal quota, however many records it has; slots that a small one can't use go to the others.
   Each is clustered again into as many kinds as its quota, on all its words: random directions weighted by how
   unevenly the word is spread over the topics and by how rare it is in its own one. So names and phrases that occur
   everywhere don't count, and frequent kinds count less. The kinds again get equal quotas; within a kind the records
   are drawn by a seeded hash.

Only centres, drawn texts, word counts and the matrix reach the driver, all of bounded size (``BUCKETS`` times topics,
``CORE`` squared, some ``DRAWN`` texts or ``OVER`` a centre each pass). Rows are never ranked by cluster: quotas are
taken from counts by cluster and key prefix.

Defined results: NULL, blank and wordless records are never chosen; of records with the same words the one with
the least id stands for all; fewer distinct records than asked give all of them; ids must be unique.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.operators.sampling import take_quota
from curaspark.session import ship
from curaspark.storage import materialize, release

DIMS = 64
BUCKETS = 1 << 17
CORE, CHANCE, EIGEN, WEAK = 2048, 20.0, 24, 0.05
BATCHES, EPOCHS, STILL = 5, 2, 1e-3
RESTARTS, LLOYD = 8, 12
ROUNDS, OVER, DRAWN = 3, 2, 1000
CACHE_WORDS = 400_000
PIECE = 1000
WORD = re.compile(r"[^\W\d_]+")
ROWS = "id long, x binary, grp int, batch int"


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS
        self[word] = value
        return value


@lru_cache(maxsize=1)
def directions() -> np.ndarray:
    """A random direction for each bucket, the same everywhere; held once a worker."""
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMS), dtype=np.float32)


def distinct_texts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of one record for each sequence of words."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+", " "))
    named = records.select(F.col(id_col).cast("long").alias("id"), plain.alias("text")).where(F.col("text").rlike(r"\p{L}") & F.col("id").isNotNull())
    key = F.struct(F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    least = named.groupBy(key.alias("key")).agg(F.min("id").alias("id"))
    return named.join(least.select("id"), "id", "left_semi").dropDuplicates(["id"])


def word_lists(texts: DataFrame) -> DataFrame:
    """``id, words binary (int32), batch``: the buckets of the distinct words of each text, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets()
        for batch in batches:
            lists = [np.array(sorted({bucket_of[w] for w in WORD.findall(t.lower())}), dtype=np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, type=pa.binary())], names=["id", "words"])

    made = texts.select("id", "text").mapInArrow(run, "id long, words binary")
    return materialize(made.withColumn("batch", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(BATCHES)).cast("int")), "word-lists")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' buckets, and the number of each."""
    lists = column.to_pylist()
    return np.frombuffer(b"".join(lists), dtype=np.int32), np.array([len(x) // 4 for x in lists], dtype=np.int64)


def document_frequencies(lists: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold a word of each bucket, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for part in _pieces(batches):
            counts[:BUCKETS] += np.bincount(_flat(part.column(0))[0], minlength=BUCKETS)
            rows += part.num_rows
        counts[BUCKETS] = rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    rows = lists.select("words").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 1, dtype=np.int64)  # BUCKETS rows at most
    counts[rows.bucket.to_numpy(dtype=np.int64)] = rows.n.to_numpy()
    return counts[:BUCKETS], int(counts[BUCKETS])


def pair_counts(lists: DataFrame, core: np.ndarray) -> np.ndarray:
    """Texts that hold both words, for each pair of core words; the lower triangle stays 0."""
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[core] = np.arange(len(core))
    n = len(core)
    shared = lists.sparkSession.sparkContext.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        total = np.zeros(n * n, dtype=np.int32)
        waiting: list[np.ndarray] = []
        held = 0
        for part in _pieces(batches):
            flat, sizes = _flat(part.column(0))
            own = place[flat]
            owner = np.repeat(np.arange(len(sizes)), sizes)[own >= 0]
            own = own[own >= 0].astype(np.int64)
            ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))[owner]
            after = ends - np.arange(len(own)) - 1  # core words of the same text that follow
            first = np.repeat(np.arange(len(own)), after)
            second = np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after) + first + 1
            a, b = own[first], own[second]
            waiting.append(np.minimum(a, b) * n + np.maximum(a, b))
            held += len(a)
            if held > 8_000_000:
                total += np.bincount(np.concatenate(waiting), minlength=n * n).astype(np.int32)
                waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=n * n).astype(np.int32)
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(total)
        starts = np.searchsorted(cells, np.arange(n + 1) * n)
        some = np.flatnonzero(np.diff(starts))
        where, times = (cells % n).astype(np.int32), total[cells].astype(np.int64)
        cut = lambda x, k: x[starts[k] : starts[k + 1]].tobytes()
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cut(where, k) for k in some], type=pa.binary()), pa.array([cut(times, k) for k in some], type=pa.binary())], names=["word", "others", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, others, times in zip(*(c.to_pylist() for c in batch.columns)):
                row = sums.setdefault(word, np.zeros(n, dtype=np.int64))
                row[np.frombuffer(others, dtype=np.int32)] += np.frombuffer(times, dtype=np.int64)
        total = np.zeros(n * n, dtype=np.int64) if sums else np.zeros(0, dtype=np.int64)
        for word, row in sums.items():
            total[word * n : (word + 1) * n] = row
        if sums:
            yield packed(total)

    kinds = "word int, others binary, times binary"
    made = lists.select("words").mapInArrow(count, kinds).repartition("word").mapInArrow(add, kinds).toPandas()  # CORE squared counts at most
    table = np.zeros((n, n))
    for word, others, times in made.itertuples(index=False):
        table[word, np.frombuffer(others, dtype=np.int32)] = np.frombuffer(times, dtype=np.int64)
    return table


def topical_table(pairs: np.ndarray, found: np.ndarray, total: int) -> np.ndarray:
    """Core words x topics: leading eigenvectors of the logarithm of co-occurrence above chance."""
    expected = np.outer(found, found) / max(1, total)
    excess = np.maximum(0, np.log((pairs + pairs.T + 1) / (expected + 1))) * np.sqrt(np.minimum(1, expected / CHANCE))
    np.fill_diagonal(excess, 0)
    n = len(excess)
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((n, min(n, EIGEN + 8))))[0]
    for _ in range(40):
        basis = np.linalg.qr(excess @ basis + basis)[0]
    values, turn = np.linalg.eigh(basis.T @ excess @ basis)
    values, vectors = values[::-1][:EIGEN], (basis @ turn)[:, ::-1]
    values = values[values > max(1e-9, WEAK * values[0])] if len(values) else values
    drops = values[:-1] / values[1:] if len(values) == EIGEN else values / np.append(values[1:], WEAK * values[:1])
    topics = int(drops.argmax()) + 1 if len(drops) else len(values)
    return (vectors[:, :topics] * np.sqrt(values[:topics])).astype(np.float32)


def _sums(flat: np.ndarray, sizes: np.ndarray, rows_of) -> np.ndarray:
    """At length 1, the sum of the vectors of each text's words; ``rows_of`` gives the vectors of words at positions."""
    width = rows_of(slice(0, 0)).shape[1]
    out = np.zeros((len(sizes), width), dtype=np.float32)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(rows_of(slice(None)), (np.cumsum(sizes) - sizes)[some], axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def topical_rows(lists: DataFrame, core: np.ndarray, topical: np.ndarray) -> DataFrame:
    """Rows to cluster (``ROWS``) of all texts, in one group."""
    table = np.zeros((BUCKETS, topical.shape[1]), dtype=np.float32)
    table[core] = topical
    shared = lists.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in _pieces(batches):
            flat, sizes = _flat(part.column(1))
            yield _packed(part.column(0), _sums(flat, sizes, lambda at: table[flat[at]]), np.zeros(part.num_rows), part.column(2))

    return materialize(lists.select("id", "words", "batch").mapInArrow(run, ROWS), "topical-rows", ("batch",))


def kind_rows(lists: DataFrame, topics: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Rows to cluster of all texts, in the groups of their topics, by words that tell kinds apart."""
    spark = lists.sparkSession
    joined = materialize(lists.join(topics.select("id", "grp"), "id"), "topic-lists")
    n = max(sizes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS * n, dtype=np.int64)
        for part in _pieces(batches):
            flat, own = _flat(part.column(0))
            counts += np.bincount(flat.astype(np.int64) * n + np.repeat(part.column(1).to_numpy(), own), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    rows = joined.select("words", "grp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS * n)  # BUCKETS rows a topic at most
    counts[rows.cell.to_numpy(dtype=np.int64)] = rows.n.to_numpy()
    counts = counts.reshape(BUCKETS, n)
    size = np.array([sizes.get(k, 0) for k in range(n)], dtype=float)
    share = size / size.sum()
    spread = (counts + CHANCE * share) / (counts.sum(1, keepdims=True) + CHANCE)
    told = np.where(spread > 0, spread * np.log(np.where(spread > 0, spread, 1) / np.where(share > 0, share, 1)), 0).sum(1)
    uneven = np.sqrt(np.maximum(told, 0)) if (size > 0).sum() > 1 else np.ones(BUCKETS)
    rare = np.log((size + 1) / (counts + 1)) * (counts > 0)
    shared = spark.sparkContext.broadcast((uneven[:, None] * rare).astype(np.float32))  # BUCKETS numbers a topic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ways = shared.value, directions()
        for part in _pieces(batches):
            flat, own = _flat(part.column(1))
            weight = weights[flat, np.repeat(part.column(2).to_numpy(), own)][:, None]
            yield _packed(part.column(0), _sums(flat, own, lambda at: ways[flat[at]] * weight[at]), part.column(2).to_numpy(), part.column(3))

    made = materialize(joined.select("id", "words", "grp", "batch").mapInArrow(run, ROWS), "kind-rows", ("batch",))
    release(joined)
    return made


def _packed(ids: pa.Array, x: np.ndarray, groups: np.ndarray, batch: pa.Array) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, dtype=np.float16)
    return pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], type=pa.binary()), pa.array(groups.astype(np.int32)), batch], names=["id", "x", "grp", "batch"])


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.to_pylist()
    return np.frombuffer(b"".join(lists), dtype=np.float16).reshape(len(lists), -1).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)


def _hot(of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(of), n), dtype=np.float32)
    out[np.arange(len(of)), of] = 1
    return out


def start_centres(x: np.ndarray, clusters: int, seed: int, weight: np.ndarray) -> np.ndarray:
    """Best of ``RESTARTS`` k-means++ starts after ``LLOYD`` plain k-means steps on the given rows, each standing for ``weight`` texts."""
    rng = np.random.default_rng(seed)
    best, least = x[:1].copy(), np.inf
    for _ in range(RESTARTS):
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        apart = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(clusters, len(x)) and apart.max() > 1e-9:
            chance = apart * weight
            chosen.append(int(rng.choice(len(x), p=chance / chance.sum())))
            apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
        centres = x[chosen].copy()
        for _ in range(LLOYD):
            of = _nearest(x, centres)
            n = np.bincount(of, weights=weight, minlength=len(centres))
            sums = _hot(of, len(centres)).T @ (x * weight[:, None])
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        loss = (((x - centres[_nearest(x, centres)]) ** 2).sum(1) * weight).sum()
        if loss < least:
            best, least = centres, loss
    return best


def _apart(x: np.ndarray, own: np.ndarray, centres: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row's own group (-1 where it has none) and the squared distance from it (there 1)."""
    of, apart = np.full(len(x), -1), np.ones(len(x))
    for g in np.unique(own):
        rows, at = np.flatnonzero(own == g), np.flatnonzero(groups == g)
        if len(at):
            near = at[_nearest(x[rows], centres[at])]
            of[rows], apart[rows] = near, ((x[rows] - centres[near]) ** 2).sum(1)
    return of, apart


def drawn_texts(rows: DataFrame, sizes: dict[int, int], clusters: dict[int, int], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts drawn from all rows by squared distance, the group of each and how many rows of the group are nearest to it."""
    spark = rows.sparkSession
    centres, groups = np.zeros((0, 0), dtype=np.float32), np.zeros(0, dtype=np.int32)
    wanted = {g: max(OVER * k, DRAWN // (ROUNDS * len(clusters))) for g, k in clusters.items()}
    cost = {g: float(sizes[g]) for g in clusters}
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((centres, groups, {g: wanted[g] / max(cost[g], 1e-9) for g in clusters}))

        def draw(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centres, groups, chance = shared.value
            left: dict[int, float] = dict.fromkeys(chance, 0.0)
            for part in _pieces(batches):
                own = part.column(1).to_numpy()
                _, apart = _apart(_matrix(part.column(0)), own, centres, groups)
                even = ((part.column(2).to_numpy().view(np.uint64) >> np.uint64(11)) + 0.5) / 2**53
                for g in np.unique(own).tolist():
                    left[g] += float(apart[own == g].sum())
                taken = np.flatnonzero((even < apart * np.array([chance[g] for g in own.tolist()])) & (apart > 1e-6))
                if len(taken):
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(taken)), part.column(0).take(pa.array(taken)), pa.array(np.zeros(len(taken)))], names=["grp", "x", "cost"])
            some = list(left)
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array([None] * len(some), type=pa.binary()), pa.array([left[g] for g in some], type=pa.float64())], names=["grp", "x", "cost"])

        even = F.xxhash64(F.lit(seed), F.lit(turn), "id").alias("h")
        # about ``wanted`` drawn texts of each group and its cost: bounded by the number of clusters
        found = rows.select("x", "grp", even).mapInArrow(draw, "grp int, x binary, cost double").groupBy("grp", "x").agg(F.sum("cost").alias("cost")).orderBy("grp", "x").toPandas()
        costs = found[found.x.isna()]
        cost = dict(zip(costs.grp, costs.cost))
        found = found[~found.x.isna()]
        if len(found):
            more = _matrix(pa.array(found.x.tolist(), type=pa.binary()))
            centres = np.concatenate([centres, more]) if len(centres) else more
            groups = np.concatenate([groups, found.grp.to_numpy(dtype=np.int32)])
    shared = spark.sparkContext.broadcast((centres, groups))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, groups = shared.value
        counts = np.zeros(len(centres), dtype=np.int64)
        for part in _pieces(batches):
            of, _ = _apart(_matrix(part.column(0)), part.column(1).to_numpy(), centres, groups)
            counts += np.bincount(of[of >= 0], minlength=len(centres))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cluster", "n"])

    total = rows.select("x", "grp").mapInArrow(count, "cluster int, n long").groupBy("cluster").agg(F.sum("n").alias("n")).toPandas()  # a row a drawn text
    weight = np.zeros(len(centres))
    weight[total.cluster.to_numpy(dtype=np.int64)] = total.n.to_numpy()
    return centres, groups, weight


def fit_clusters(rows: DataFrame, sizes: dict[int, int], clusters: dict[int, int], seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the group of each, by mini-batch k-means over all batches. ``clusters``: centres wanted by group."""
    spark = rows.sparkSession
    clusters = {g: k for g, k in clusters.items() if k}
    rows = rows.where(F.col("grp").isin([int(g) for g in clusters]))
    drawn, of, weight = drawn_texts(rows, sizes, clusters, seed)
    parts = [(g, start_centres(drawn[own], clusters[g], seed, weight[own])) for g in sorted(clusters) if (own := (of == g) & (weight > 0)).any()]
    if not parts:
        return np.zeros((0, 0), dtype=np.float32), np.zeros(0, dtype=np.int32)
    centres, groups = np.concatenate([x for _, x in parts]), np.concatenate([np.full(len(x), g, dtype=np.int32) for g, x in parts])
    seen = np.zeros(len(centres))
    for _ in range(EPOCHS):
        before = centres
        for batch in range(BATCHES):
            shared = spark.sparkContext.broadcast((centres, groups))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                centres, groups = shared.value
                sums, counts = np.zeros(centres.shape), np.zeros(len(centres), dtype=np.int64)
                for part in _pieces(batches):
                    x = _matrix(part.column(0))
                    of, _ = _apart(x, part.column(1).to_numpy(), centres, groups)
                    kept = of >= 0
                    sums += _hot(of[kept], len(centres)).T @ x[kept]
                    counts += np.bincount(of[kept], minlength=len(centres))
                cells = np.concatenate([sums, counts[:, None]], axis=1)[counts > 0]
                at = (np.flatnonzero(counts)[:, None] * cells.shape[1] + np.arange(cells.shape[1])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(cells.ravel())], names=["cell", "total"])

            made = rows.where(F.col("batch") == batch).select("x", "grp").mapInArrow(run, "cell long, total double")
            total = made.groupBy("cell").agg(F.sum("total").alias("total")).toPandas()  # a cell a cluster and dimension
            if len(total):
                cells = np.zeros(len(centres) * (centres.shape[1] + 1))
                cells[total.cell.to_numpy()] = total.total.to_numpy()
                cells = cells.reshape(len(centres), -1)
                at = np.flatnonzero(cells[:, -1])
                n = cells[at, -1]
                mean = cells[at, :-1] / n[:, None]
                seen[at] += n
                centres = centres.copy()
                centres[at] += ((n / seen[at])[:, None] * (mean - centres[at])).astype(np.float32)
        if (((centres - before) ** 2).sum(1) * seen).sum() / max(seen.sum(), 1) < STILL:
            break
    return centres, groups


def assign(rows: DataFrame, centres: np.ndarray, groups: np.ndarray, name: str) -> DataFrame:
    """``id, grp`` with the nearest centre of its group as the new ``grp``."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, groups = shared.value
        for part in _pieces(batches):
            of, _ = _apart(_matrix(part.column(1)), part.column(2).to_numpy(), centres, groups)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of.astype(np.int32))], names=["id", "grp"]).filter(pa.array(of >= 0))

    return materialize(rows.select("id", "x", "grp").mapInArrow(run, "id long, grp int"), name)


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster


def quotas(sizes: dict[int, int], rows: int) -> dict[int, int]:
    """Equal quotas; what a small cluster can't use is dealt to the others, one slot each from the smallest cluster on."""
    rows = min(rows, sum(sizes.values()))
    out = dict.fromkeys(sizes, 0)
    left = rows
    while left:
        open_ = sorted((c for c in sizes if out[c] < sizes[c]), key=lambda c: (out[c], sizes[c], c))
        each = left // len(open_)
        if each:
            for c in open_:
                take = min(each, sizes[c] - out[c])
                out[c] += take
                left -= take
        else:
            for c in open_[:left]:
                out[c] += 1
            left = 0
    return out


def choose(records: DataFrame, rows: int, id_col: str = "ord", text_col: str = "persona", seed: int = 42) -> DataFrame:
    """``id_col, topic, cluster, cluster_size`` of the chosen records."""
    spark = records.sparkSession
    ship(spark)
    lists = word_lists(distinct_texts(records, id_col, text_col))
    found, total = document_frequencies(lists)
    if not total or rows < 1:
        return spark.createDataFrame([], f"`{id_col}` long, topic int, cluster int, cluster_size long")
    core = np.sort(np.argsort(-found, kind="stable")[: min(CORE, int((found > 0).sum()))])
    topical = topical_table(pair_counts(lists, core), found[core].astype(float), total)
    if topical.shape[1]:
        wide = topical_rows(lists, core, topical)
        topics = assign(wide, *fit_clusters(wide, {0: total}, {0: min(topical.shape[1], rows)}, seed), "topics")
        release(wide)
    else:
        topics = materialize(lists.select("id", F.lit(0).alias("grp")), "topics")
    of_topic = _sizes(topics)
    share = quotas(of_topic, rows)
    kinds = kind_rows(lists, topics, of_topic)
    centres, groups = fit_clusters(kinds, of_topic, share, seed)
    parts = assign(kinds, centres, groups, "kinds")
    release(lists, topics, kinds)
    sizes = _sizes(parts)
    wanted: dict[int, int] = {}
    for topic, slots in share.items():
        wanted |= quotas({c: n for c, n in sizes.items() if groups[c] == topic}, slots)
    quota = spark.createDataFrame([(c, int(groups[c]), q, sizes[c]) for c, q in wanted.items() if q], "grp int, topic int, quota long, cluster_size long")
    chosen = take_quota(parts.join(F.broadcast(quota), "grp"), ["grp"], "quota", "id", seed)  # a row a cluster is broadcast, no more than slots
    return chosen.select(F.col("id").alias(id_col), "topic", F.col("grp").alias("cluster"), "cluster_size")
