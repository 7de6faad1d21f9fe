"""K-means with ns-bounds, in whole numbers.

Method: a vector keeps, for every centroid, the distance that was last evaluated and the round of that evaluation.  The history of
all centroids is kept too, so a later bound is that distance loosened by the norm of the centroid's *total* displacement since
then, |C(now) - C(then)|, which is never more than the sum of its moves round by round.  A centroid whose lower bound lies above
the upper bound of the vector's own centroid cannot be nearest, nor tie; all others are evaluated again, exactly.

Spark keeps the vectors with their bounds in one table for each round, in the shared folder, and sums clusters by aggregation with
partial sums in every task, so a cluster of any size costs its reducer one row for each task.  Only the ``k`` centroids and the
history of ``rounds`` of them reach the driver.  A round's table is removed as soon as the next one is written.

Distances are exact: components of at most ``SMALL`` are compared in doubles, in which all these sums are whole numbers below 2^53;
vectors with larger ones are compared with every centroid in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicell.llm.shared import cut, map_batches, remove_folder, shared_folder

#: Components up to this size have exact squared distances in doubles, for up to 64 of them (fewer bits for longer vectors).
SMALL = 1 << 22
#: Stored distances are rounded to single precision; bounds allow for a relative error of this size.
SLACK = 2.0**-22
_PAIRS = 1 << 15
_LONG = (1 << 63) - 1

STATE = "vec_id long, small array<long>, wide array<double>, cluster int, distance array<float>, seen array<tinyint>, own string, evaluated int"


def whole(vector: list[float], scale: int) -> list[int]:
    """``floor(scale * x)`` of each component in exact arithmetic, for a ``scale`` that is a power of two."""
    return [int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x) for x in vector]


class Centroids:
    """The history of all centroids, as a task uses it."""

    def __init__(self, history: list[list[list[int]]]):
        self.now = history[-1]
        big = np.array([max(map(abs, c)) > SMALL for c in self.now])
        self.big = np.flatnonzero(big)
        self.matrix = np.array([[0] * len(c) if b else c for c, b in zip(self.now, big)], float)
        self.squares = (self.matrix**2).sum(1)
        #: ``moved[t, j]``: how far centroid j has moved since round t, all in all.
        self.moved = np.array([[self._norm(a, b) for a, b in zip(then, self.now)] for then in history])

    @staticmethod
    def _norm(a: list[int], b: list[int]) -> float:
        return _root(np.array([sum((x - y) ** 2 for x, y in zip(a, b))], object))[0] * (1 + 1e-12)

    def evaluate(self, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs (vector i, centroid j); whole numbers in doubles, Python's integers where a centroid is large."""
        if len(i) * 8 > len(vectors) * len(self.matrix):
            rows = (vectors**2).sum(1)[:, None] + self.squares - 2 * (vectors @ self.matrix.T)
            found = rows[i, j]
        else:
            found = np.empty(len(i))
            for at in range(0, len(i), _PAIRS):
                apart = vectors[i[at : at + _PAIRS]] - self.matrix[j[at : at + _PAIRS]]
                found[at : at + _PAIRS] = np.einsum("ij,ij->i", apart, apart)
        if len(self.big):
            found = found.astype(object)
            for p in np.flatnonzero(np.isin(j, self.big)):
                found[p] = sum((int(x) - y) ** 2 for x, y in zip(vectors[i[p]], self.now[j[p]]))
        return found


def _root(squares: np.ndarray) -> np.ndarray:
    """Distances; not a number where single precision has none, which fails every bound, so that it is evaluated again."""
    if squares.dtype == object:
        squares = np.array([float(s) if s < 1 << 240 else np.nan for s in squares])
    return np.sqrt(squares)


def assign(vectors: np.ndarray, cluster: np.ndarray | None, distance: np.ndarray | None, seen: np.ndarray | None, centroids: Centroids):
    """The nearest centroid of each vector, the smaller number of equals: ``(cluster, distance, seen, own, evaluated)``.

    ``own`` is the exact squared distance to it where it was evaluated in this round, else -1; ``evaluated`` counts exact distances.
    """
    now, n, k = len(centroids.moved) - 1, len(vectors), len(centroids.matrix)
    every = np.arange(n)
    exact = np.full((n, k), np.inf, object if len(centroids.big) else float)
    if cluster is None:  # nothing is known yet
        i, j = np.repeat(every, k), np.tile(np.arange(k), n)
        exact[i, j] = centroids.evaluate(vectors, i, j)
        cluster = np.argmin(exact, 1)
        return cluster, _root(exact.ravel()).reshape(n, k).astype(np.float32), np.full((n, k), now, np.int8), exact[every, cluster], np.full(n, k)

    def upper() -> np.ndarray:
        return distance[every, cluster] * (1 + SLACK) + centroids.moved[seen[every, cluster], cluster]

    def failing() -> np.ndarray:
        low = distance * (1 - SLACK) - centroids.moved[seen, np.arange(k)]
        fails = ~(low > upper()[:, None])
        fails[every, cluster] = False
        return fails

    distance, seen = distance.astype(float), seen.copy()
    rows = np.flatnonzero(failing().any(1))  # first the own centroid, which may settle it
    exact[rows, cluster[rows]] = centroids.evaluate(vectors, rows, cluster[rows])
    distance[rows, cluster[rows]], seen[rows, cluster[rows]] = _root(exact[rows, cluster[rows]]), now
    i, j = np.nonzero(failing())
    exact[i, j] = centroids.evaluate(vectors, i, j)
    distance[i, j], seen[i, j] = _root(exact[i, j]), now
    evaluated = np.bincount(rows, minlength=n) + np.bincount(i, minlength=n)
    cluster = cluster.copy()
    cluster[rows] = np.argmin(exact[rows], 1)
    own = np.where(np.isin(every, rows), exact[every, cluster], -1)
    return cluster, distance.astype(np.float32), seen, own, evaluated


def _pass(history: list[list[list[int]]], scale: int, last: bool):
    """Over rows of ``STATE``: assigned to the newest centroids; in the ``last`` pass every own distance is evaluated."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        centroids, n, k = Centroids(history), batch.num_rows, len(history[0])
        names = batch.schema.names
        column = {c: batch.column(i) for i, c in enumerate(names)}
        small = column["small"].is_valid().to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(small)
        matrix = lambda c, kind: column[c].flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(plain), -1)
        cluster, evaluated, own = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        distance, seen = [None] * n, [None] * n
        if len(plain):
            vectors, known = matrix("small", float), column["distance"].null_count < n
            before = (np.array(column["cluster"].to_numpy(zero_copy_only=False)[plain], np.int64), matrix("distance", float), matrix("seen", np.int64)) if known else (None, None, None)
            cluster[plain], d, s, exact, evaluated[plain] = assign(vectors, *before, centroids)
            if last:
                left = np.flatnonzero(exact == -1)
                exact[left] = centroids.evaluate(vectors, left, cluster[plain][left])
            for p, row, x, y, e in zip(plain.tolist(), range(n), d, s, exact.tolist()):
                distance[p], seen[p], own[p] = x, y.astype(np.int8), str(int(e))
        for p in np.flatnonzero(~small).tolist():
            vector = whole(column["wide"][p].as_py(), scale)
            squares = [sum((x - y) ** 2 for x, y in zip(vector, c)) for c in history[-1]]
            cluster[p], own[p], evaluated[p] = squares.index(min(squares)), str(min(squares)), k
        out = {"cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.list_(pa.float32())), "seen": pa.array(seen, pa.list_(pa.int8())), "own": pa.array(own), "evaluated": pa.array(evaluated, pa.int32())}
        return pa.RecordBatch.from_arrays([out.get(c, column[c]) for c in names], names=names)

    return run


def _wide_sums(scale: int):
    """Sums of vectors with large components by cluster, one row for each cluster in each task, as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for c, n, x, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row, total = ([int(v) for v in s] if s else whole(x, scale)), sums.setdefault(c, [0, None])
                total[0] += n
                total[1] = row if total[1] is None else [a + b for a, b in zip(total[1], row)]
        yield pa.RecordBatch.from_pydict({"cluster": list(sums), "n": [t[0] for t in sums.values()], "wide": [None] * len(sums), "sums": [[str(v) for v in t[1]] for t in sums.values()]}, schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("wide", pa.list_(pa.float64())), ("sums", pa.list_(pa.string()))]))

    return run


def _moved(state: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The floor of each cluster's mean; an empty cluster keeps its centroid."""
    width = len(centroids[0])
    total = {c: [0, [0] * width] for c in range(len(centroids))}

    def add(c: int, n: int, sums: list) -> None:
        total[c] = [total[c][0] + n, [a + int(b) for a, b in zip(total[c][1], sums)]]

    small = state.filter("small is not null").groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("small")[i]).alias(f"s{i}") for i in range(width)])
    for r in small.collect():  # k rows
        add(r["cluster"], r["n"], r[2:])
    wide = state.filter("wide is not null").select("cluster", F.lit(1).cast("long").alias("n"), "wide", F.lit(None).cast("array<string>").alias("sums"))
    if not wide.isEmpty():
        schema = "cluster int, n long, wide array<double>, sums array<string>"
        wide = wide.mapInArrow(_wide_sums(scale), schema).repartition("cluster").mapInArrow(_wide_sums(scale), schema)  # a row for each cluster and task
        for r in wide.collect():  # k rows
            add(r["cluster"], r["n"], r["sums"])
    return [[s // n for s in sums] if n else centroids[c] for c, (n, sums) in total.items()]


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:", work: list | None = None) -> DataFrame:
    """One row for each vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``width`` components, none null or non-finite, take part, each component as ``floor(scale * x)``; ``scale`` must be a power of two; at most 126 rounds.
    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed`` and id; a null id counts as empty text, of rows with
    one id the smaller vectors come first, and fewer vectors make fewer centroids.  Repeated rows count as often as they stand there.
    No vectors give no rows; other columns are ignored.  A distance or sum that no long can hold is null; its cluster is right all the same.
    ``work``, if given, gets the number of exact distances of each pass.
    """
    spark = embeddings.sparkSession
    limit = SMALL if width <= 64 else math.isqrt((1 << 50) // width)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(f"size(x) = {width} and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    small = f"forall(x, v -> abs(v) * {scale} < {limit})"
    state = rows.selectExpr(
        "vec_id", f"case when {small} then transform(x, v -> floor(v * {scale})) end as small", f"case when not {small} then x end as wide",
        "cast(null as int) as cluster", "cast(null as array<float>) as distance", "cast(null as array<tinyint>) as seen", "cast(null as string) as own", "cast(null as int) as evaluated",
    )
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    history = [[whole(r["x"], scale) for r in rows.orderBy(digest, "x").limit(k).select("x").collect()]]  # k vectors
    folder = f"{shared_folder(spark)}/nsbounds-{uuid.uuid4()}"
    if not history[0]:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for t in range(rounds + 1):
        map_batches(state, _pass(history, scale, t == rounds), STATE).write.parquet(f"{folder}/{t}")
        if t:
            remove_folder(spark, f"{folder}/{t - 1}")
        state = spark.read.schema(STATE).parquet(f"{folder}/{t}")
        if work is not None:
            work.append(state.agg(F.sum(F.col("evaluated").cast("long"))).first()[0])
        if t < rounds:
            history.append(_moved(state, history[-1], scale))
    found = cut(state.selectExpr("vec_id", "cluster", "try_cast(own as bigint) as distance"))
    remove_folder(spark, folder)
    return _with_sums(spark, found, history[-1])


def _with_sums(spark: SparkSession, found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows with their cluster's sums and digest; one row for each of the ``k`` clusters is joined to them."""
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("inertia")
    by_cluster = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(whole_sum).collect()}  # k rows
    fits = lambda v: None if v is None or v > _LONG else int(v)
    total = None if None in by_cluster.values() else sum(by_cluster.values())
    told = [(c, fits(v), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in by_cluster.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same clusters in DuckDB SQL, all distances in every round."""
    parts = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY digest, q) - 1 AS c, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS digest, q FROM kept ORDER BY digest, q LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"a{t} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, min(d) AS d, CAST(arg_min(c, d * 1000 + c) AS INTEGER) AS cluster FROM (SELECT row, vec_id, k.q, c, "
            f"CAST(list_sum(list_transform(list_zip(k.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k CROSS JOIN c{t} m) GROUP BY row)"
        )
        if t < rounds:
            parts.append(
                f"m{t} AS (SELECT cluster AS c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (SELECT cluster, i, count(*) AS n, sum(v) AS s FROM "
                f"(SELECT cluster, unnest(q) AS v, unnest(range(64)) AS i FROM a{t}) GROUP BY cluster, i) GROUP BY cluster), "
                f"c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(list_transform(m.q, lambda v: CAST(v AS BIGINT)), c.q) AS q FROM c{t} c LEFT JOIN m{t} m ON c.c = m.c)"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON a.cluster = m.c"
    )


CLUSTER_SQL = _sql()
