"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  That order is computed once for every row, and the rows
are stored with it, ranged by their nearest pivots: each part of the table is a block of the index, and what it
holds of a pivot's inverted file is the vectors of the block that have the pivot among their nearest, with its place.  A query
reads the lists of its own pivots (those a block does not have cost nothing), adds up the footrule distance, and
reranks every vector within its cutoff by exact cosine.

The cutoff is a quantile of the query's own distances to a bounded sample.  Which quantile follows from a recall target: the
one within which that part of the sample's true neighbours lies.  Nothing is capped.  Queries go in blocks
of a bounded size against all rows; results of a block are stored before the next one is asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicell.llm.shared import cut, in_small_batches, map_batches, shared_folder, uniform_bits

#: Pivots, and how many of them represent a vector.
PIVOTS, PLACES = 1024, 64
#: Part of the true neighbours that should be within the cutoff; rows of the sample that sets it; rows asked in it.
RECALL, SAMPLE, TRIED = 0.96, 1 << 14, 256
QUERY_BLOCK, VECTOR_BLOCK = 2048, 1 << 15


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component to one half or more: exact, and no square over- or underflows."""
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def cosines(vectors: np.ndarray, query: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores; both sides scaled, ``long`` the vectors' lengths."""
    return (vectors * query).sum(1) / (long * np.sqrt((query * query).sum()))


def places(vectors: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """For each (scaled) vector its ``most`` nearest of the unit pivots, nearest first; ties go to the earlier pivot."""
    out = np.empty((len(vectors), most), np.uint16)
    for at in range(0, len(vectors), 4096):
        near = -(vectors[at : at + 4096] @ pivots.T)
        some = np.sort(np.argpartition(near, most - 1, axis=1)[:, :most], axis=1)
        out[at : at + 4096] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


class Postings:
    """Pivot inverted files of one block of vectors."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.most = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=pivots)))).tolist()
        self.row, self.place = (by_pivot // self.most).astype(np.int32), (by_pivot % self.most).astype(np.int32)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's pivot order to every vector; a pivot not among the nearest stands at place ``most``."""
        k = self.most
        lists = [slice(self.bounds[p], self.bounds[p + 1]) for p in order.tolist()]
        row, place = (np.concatenate([x[s] for s in lists]) for x in (self.row, self.place))
        here = np.repeat(np.arange(k, dtype=np.int32), [s.stop - s.start for s in lists])
        return k * (k + 1) + np.bincount(row, np.abs(place - here) + place + here - 2 * k, self.rows).astype(np.int32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def quantile_for(sample: np.ndarray, orders: np.ndarray, posted: Postings, k: int, recall: float) -> float:
    """The part of the sample that must be reranked so that ``recall`` of the ``k`` true neighbours of some of its rows are."""
    needed, long = [], lengths(sample)
    for at in np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int):
        score = cosines(sample, sample[at], long)
        score[at] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        distance = np.sort(posted.footrule(orders[at]))
        needed.append(np.searchsorted(distance, posted.footrule(orders[at])[near], "right") / len(sample))
    return float(np.quantile(np.concatenate(needed), recall))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, most: int = PLACES, recall: float = RECALL) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Ranks start at 1; the largest cosine comes first, ties go to the smaller id.  Null, zero and non-finite
    vectors and null ids take no part; a query is compared with vectors of its own length.  Rows that
    share a query's id are never its candidates; a repeated query id is asked once for each length, with its smallest vector.
    With ``recall`` 1 or more every row is reranked.  An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    out = f"{shared_folder(spark)}/nearest-{uuid.uuid4()}"
    schema = "query_id long, rank int, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(out)
    in_small_batches(spark)
    for width in sorted(r["width"] for r in rows.select(F.size("embedding").alias("width")).distinct().collect()):  # lengths of vectors
        _of_width(rows.filter(F.size("embedding") == width), width, every, k, pivots, most, recall, out)
    return spark.read.schema(schema).parquet(out)


def _of_width(rows: DataFrame, width: int, every: int, k: int, pivots: int, most: int, recall: float, out: str) -> None:
    """Append the results for vectors of one length to the table ``out``."""
    spark = rows.sparkSession
    drawn = rows.orderBy(uniform_bits(F.col("vec_id"), 32, "pivot"), "vec_id", "embedding").limit(SAMPLE).toArrow()  # SAMPLE rows
    sample = scaled(_matrix(drawn.column("embedding").combine_chunks(), width))
    _, firsts = np.unique(sample, axis=0, return_index=True)  # a common vector is one pivot
    centres = sample[np.sort(firsts)[:pivots]]
    centres = centres / np.sqrt((centres * centres).sum(1, keepdims=True))
    most = min(most, len(centres))
    orders = places(sample, centres, most)
    posted = Postings(orders, len(centres))
    part = 1.0 if recall >= 1 else quantile_for(sample, orders, posted, k, recall)
    shared = spark.sparkContext.broadcast((centres, posted))  # at most PIVOTS vectors and SAMPLE pivot orders

    def order(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = scaled(_matrix(batch.column(1), width))
        found = places(vectors, shared.value[0], most)
        of = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), of(vectors), of(found), *(pa.array(found[:, min(i, most - 1)].astype(np.int32)) for i in (0, 1))], names=["vec_id", "vector", "pivots", "first", "second"])

    ordered = map_batches(rows, order, "vec_id long, vector binary, pivots binary, first int, second int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = cut(cut(ordered).repartitionByRange(parts, "first", "second", "vec_id", "vector").drop("first", "second"))

    def limit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, most)
        distances = [shared.value[1].footrule(o) for o in found]
        rank = min(len(distances[0]) - 1, int(np.ceil(part * len(distances[0]))))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([int(np.partition(d, rank)[rank]) if part < 1 else np.iinfo(np.int32).max for d in distances], pa.int64())], names=["vec_id", "vector", "pivots", "cutoff"])

    asked = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "pivots")).alias("own")).select("vec_id", "own.*")
    asked = cut(map_batches(asked, limit, "vec_id long, vector binary, pivots binary, cutoff long"))
    blocks = -(-asked.count() // QUERY_BLOCK)
    for block in range(blocks):
        asking = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()  # about QUERY_BLOCK rows
        if not asking.num_rows:
            continue
        ids, cutoffs = (asking.column(c).to_numpy() for c in ("vec_id", "cutoff"))
        wanted = np.frombuffer(b"".join(asking.column("vector").to_pylist()), float).reshape(-1, width)
        own = np.frombuffer(b"".join(asking.column("pivots").to_pylist()), np.uint16).reshape(-1, most)
        told = spark.sparkContext.broadcast((ids, wanted, own, cutoffs))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            ids, wanted, own, cutoffs = told.value
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]

            def search(held: list[pa.RecordBatch]) -> None:
                vec_ids = np.concatenate([b.column(0).to_numpy() for b in held])
                vectors = np.frombuffer(b"".join(v for b in held for v in b.column(1).to_pylist()), float).reshape(-1, width)
                posted = Postings(np.frombuffer(b"".join(v for b in held for v in b.column(2).to_pylist()), np.uint16).reshape(-1, most), len(shared.value[0]))
                long = lengths(vectors)
                for q, asker in enumerate(ids):
                    close = np.flatnonzero((posted.footrule(own[q]) <= cutoffs[q]) & (vec_ids != asker))
                    got = np.concatenate((best[q][0], vec_ids[close]))
                    score = np.concatenate((best[q][1], cosines(vectors[close], wanted[q], long[close])))
                    top = np.lexsort((got, -score))[:k]
                    best[q] = got[top], score[top]

            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= VECTOR_BLOCK:
                    search(held)
                    held = []
            if held and sum(b.num_rows for b in held):
                search(held)
            query = np.repeat(ids, [len(b[0]) for b in best])
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(run, "query_id long, vec_id long, score double")
        order_by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows from each part of the index
        top = found.withColumn("rank", F.row_number().over(order_by)).filter(F.col("rank") <= k)
        top.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        told.unpersist()
