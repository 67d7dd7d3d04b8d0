"""Approximate nearest neighbours by learned partitions.

On the driver, from a bounded sample (``SAMPLE_ROWS`` vectors for each partition, by
hash, ``MOST_ROWS`` at most): an exact neighbour graph, its balanced partition
(greedy growth, then label moves under a size limit), and a softmax classifier with
one hidden layer that learns in which partitions a vector's neighbours lie. There is
a partition for every ``PART_ROWS`` rows, 16 at least and as many as the sample allows
at most. Every row of the table is filed under the partition that the classifier
ranks first; a query visits those that it ranks highest and all rows there are
compared in double precision.

How many a query visits is measured, not set: a quarter of the sample is kept from
the fit, and the number is the smallest that finds ``recall`` of the neighbours
within that quarter. These are further away than those in the whole table, so the
recall of the search is rather higher. Vectors without structure need most partitions.

Equal vectors are one entry with its k + 1 smallest ids, as no list needs more.
Partitions are dealt to salts of bounded size, so a hot one is many tasks; queries
are copied to the salts of the partitions that they visit, and only k rows a
query and salt leave a task.

Defined cases: vectors that are null, zero, or hold null or non-finite values
take no part; nor do those whose length differs from the most common; null ids
take no part; fewer candidates than k give all of them; ties go to the smaller id;
repeated vectors are candidates each, rows of one id count once; no usable rows give
none; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship, sorted_groups, table

SALT_ROWS = 8192
PART_ROWS, SAMPLE_ROWS, MOST_ROWS, LEAST_PARTS = 4096, 256, 16_384, 16


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, max(0, len(x) - 1))), int)
    norm = (x**2).sum(1)
    for s in range(0, len(x), 512):
        d = norm[None] - 2 * x[s : s + 512] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out[s : s + len(d)] = np.argpartition(d, out.shape[1] - 1, 1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_partition(graph: np.ndarray, parts: int, rounds: int = 15, seed: int = 1, slack: float = 1.2) -> np.ndarray:
    """A part for each node: grown from seeds along edges, then every node may
    move to the part most of its neighbours are in, while that has room."""
    n = len(graph)
    rng, limit = np.random.default_rng(seed), int(np.ceil(slack * n / parts))
    part = np.full(n, -1)
    order = rng.permutation(n)
    nxt = 0
    for p in range(parts):
        while nxt < n and part[order[nxt]] >= 0:
            nxt += 1
        queue, filled = [order[nxt]] if nxt < n else [], 0
        while queue and filled < n // parts:
            v = queue.pop(0)
            if part[v] < 0:
                part[v], filled = p, filled + 1
                queue.extend(u for u in graph[v] if part[u] < 0)
    sizes = np.bincount(part[part >= 0], minlength=parts)
    for v in np.flatnonzero(part < 0):
        part[v] = sizes.argmin()
        sizes[part[v]] += 1
    back = [[] for _ in range(n)]
    for v in range(n):
        for u in graph[v]:
            back[u].append(v)
    around = [np.concatenate([graph[v], np.array(back[v], int)]) for v in range(n)]
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[around[v]], minlength=parts)
            votes[sizes >= limit] = -1
            best = votes.argmax()
            if best != part[v] and votes[best] > (part[around[v]] == part[v]).sum():
                sizes[part[v]] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax over partitions from one hidden layer."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() or 1.0
        z = (x - self.mean) / self.scale
        sizes = (z.shape[1], hidden, target.shape[1])
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        values = [*self.w, *self.b]
        m, v, t = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for s in range(0, len(order), 128):
                rows = order[s : s + 128]
                h = np.maximum(z[rows] @ self.w[0] + self.b[0], 0)
                p = self._softmax(h @ self.w[1] + self.b[1])
                g = (p - target[rows]) / len(rows)
                gh = (g @ self.w[1].T) * (h > 0)
                t += 1
                for i, grad in enumerate((z[rows].T @ gh, h.T @ g, gh.sum(0), g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    values[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def rank(self, x: np.ndarray, top: int) -> np.ndarray:
        """The partitions of highest probability, best first."""
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.b[0], 0)
        return np.argsort(-(h @ self.w[1] + self.b[1]), 1, kind="stable")[:, :top]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = ok.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))  # -0.0 is 0.0
    size = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy().reshape(len(a), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T


def needed_probes(router: Router, parts: int, x: np.ndarray, k: int, recall: float) -> int:
    """The fewest partitions in which vectors that the router hasn't seen find that
    share of their nearest among each other."""
    if len(x) < 2:
        return parts
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : min(k, len(x) - 1)]
    ranked = router.rank(x, parts)
    place = np.argsort(ranked, 1)  # by vector and partition: how many are visited before it
    visits = np.take_along_axis(place, ranked[:, 0][near], 1)
    return int(np.quantile(visits, recall, method="higher")) + 1


def fit(rows: DataFrame, total: int, k: int, recall: float) -> tuple[Router, int]:
    """Router and probes."""
    parts = max(LEAST_PARTS, min(total // PART_ROWS, MOST_ROWS // SAMPLE_ROWS))
    size = parts * SAMPLE_ROWS
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    x = _matrix(rows.where(draw < min(1.0, size / max(1, total))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * size).toArrow()["v"]) if total else np.zeros((0, 1))
    if not len(x):
        return Router(np.zeros((1, 1)), np.ones((1, 1))), 1
    cut = len(x) // 4
    unseen, x = x[:cut], np.unique(x[cut:], axis=0)
    if len(x) < 2 * parts:
        parts = 1
    graph = neighbour_graph(x, 10)
    part = balanced_partition(graph, parts) if parts > 1 else np.zeros(len(x), int)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / max(1, graph.shape[1]))
    target[np.arange(len(x)), part] += 0.5
    router = Router(x, target)
    return router, needed_probes(router, parts, unseen, k, recall)


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.93) -> DataFrame:
    """vectors(vec_id, embedding): the k nearest of each row whose id is divisible
    by ``every``: query_id, rank, vec_id, score."""
    ship(vectors.sparkSession)
    rows = materialize(usable(vectors))
    total = rows.count()
    router, probes = fit(rows, total, k, recall)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def file(batches, top):
        for batch in batches:
            if batch.num_rows:
                ranked = shared.value.rank(_matrix(batch.column("v")), top)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"parts": pa.array(list(ranked.astype(np.int32)), pa.list_(pa.int32()))})

    least = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries.mapInArrow(lambda b: file(b, 1), "v array<double>, ids array<long>, parts array<int>"))
    salts = {r["p"]: max(1, -(-r["count"] // SALT_ROWS)) for r in entries.groupBy(F.col("parts")[0].alias("p")).count().collect()}
    count = F.create_map(*[F.lit(x) for kv in (salts or {0: 1}).items() for x in kv])
    filed = entries.withColumn("p", F.col("parts")[0])
    filed = filed.select(F.lit(None).cast("long").alias("query_id"), "p", F.pmod(F.xxhash64("ids"), count[F.col("p")]).cast("int").alias("s"), "v", "ids")
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(lambda b: file(b, probes), "vec_id long, v array<double>, parts array<int>")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.explode("parts").alias("p"), "v").where(count[F.col("p")].isNotNull())
    asked = asked.select("query_id", "p", F.explode(F.sequence(F.lit(0), (count[F.col("p")] - 1).cast("int"))).alias("s"), "v", F.array().cast("array<long>").alias("ids"))

    def rerank(batches):
        for group in sorted_groups(batches, ["p", "s"]):
            ps = group.column("p").to_numpy().astype(np.int64) << 32 | group.column("s").to_numpy()
            for one in np.unique(ps):
                part = group.filter(pa.array(ps == one))
                is_query = part.column("query_id").is_valid().to_numpy()
                q, c = part.filter(pa.array(is_query)), part.filter(pa.array(~is_query))
                if not q.num_rows or not c.num_rows:
                    continue
                x, y = _matrix(q.column("v")), _matrix(c.column("v"))
                ids, names = c.column("ids").to_pylist(), q.column("query_id").to_pylist()
                norm, found = (y**2).sum(1), []
                for s in range(0, len(x), 256):
                    d = (x[s : s + 256] ** 2).sum(1)[:, None] + norm - 2 * x[s : s + 256] @ y.T
                    at = min(k + 1, d.shape[1]) - 1
                    edge = np.partition(d, at, 1)[:, at]
                    for i, row in enumerate(d):
                        near = np.flatnonzero(row <= edge[i] + 1e-9 * (1 + abs(edge[i])))
                        exact = np.sqrt(((x[s + i] - y[near]) ** 2).sum(1))
                        each = sorted((e, v) for e, j in zip(exact.tolist(), near) for v in ids[j] if v != names[s + i])[:k]
                        found += [(names[s + i], v, e) for e, v in each]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in zip(*found)], ["query_id", "vec_id", "score"])

    pairs = filed.union(asked).repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
