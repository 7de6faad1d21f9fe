"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Each shard has many points on a ring of 2^32 places and owns the arc that ends at each of them.  A
document falls on the ring by its id and its text's CRC, so rows that share an id, or have none, do not share a place.  A shard takes documents of its own arcs, in ring order, until it
is full; what overflows continues clockwise to the next arc whose shard has room.  Only arc counts
(points x shards numbers, however many documents there are) decide who takes what, as intervals of a
document's rank in its arc; ranks come from counts of small ring cells plus a window inside a cell, so
no task ever holds an arc.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicell.llm.shared import cut, power_of_two, uniform_bits

SHARDS, POINTS = 16, 64
CELL_ROWS, MOST_CELLS = 256, 1 << 16
_RING = 1 << 32


def ring(shards: int = SHARDS, points: int = POINTS) -> list[tuple[int, int]]:
    """``(place, shard)`` of every virtual node, by place; fixed by the two numbers alone."""
    placed: dict[int, int] = {}
    for shard in range(shards):
        for point in range(points):
            place = int(hashlib.md5(f"shard {shard} point {point}".encode()).hexdigest()[:8], 16)
            placed.setdefault(place, shard)
    return sorted(placed.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may hold.  Without slack they add up to ``rows`` and are at most one apart."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``(arc, first rank, end rank, shard)`` intervals for arcs in clockwise order.

    Every shard first takes from its own arcs, then each arc's overflow walks on clockwise.
    """
    room, taken, waiting = list(room), [], []
    for arc, (count, shard) in enumerate(zip(counts, owners)):
        own = min(count, room[shard])
        room[shard] -= own
        if own:
            taken.append((arc, 0, own, shard))
        if count > own:
            waiting.append((arc, own, count))
    for arc, start, end in waiting:
        at = arc
        while start < end:
            at = (at + 1) % len(owners)
            more = min(end - start, room[owners[at]])
            if more:
                room[owners[at]] -= more
                taken.append((arc, start, start + more, owners[at]))
                start += more
    return taken


def shard_documents(documents: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = 0.0) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one for each document.

    ``size`` is the text's UTF-8 bytes plus one, ``slot`` numbers the rows of a shard without gaps from 0.
    With ``slack`` 0 shard counts are at most one apart (law ``rows``); with more, a shard holds at most
    (1 + slack) times the mean, fewer documents move, and ``law`` is null.  ``grown_shard`` is always null.

    A null text counts as empty and a null id as an id of its own.  Rows at one place are ordered by id, the text's CRC and
    size; rows equal in all of these are interchangeable.  An empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), F.crc32(text).cast("string"))
    place = uniform_bits(known, 32, "document ")
    rows = cut(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            place.alias("place"),
        )
    )
    total = rows.count()
    nodes = ring(shards, points)
    owners = [shard for _, shard in nodes] + [nodes[0][1]]  # after the last node the ring starts again
    cells = power_of_two(max(64, -(-total // CELL_ROWS)), MOST_CELLS)
    width = _RING // cells
    cut_cells = []
    places = [p for p, _ in nodes]
    for coarse in range(64):  # arcs that meet each 64th of the ring, so that a row looks at few of them
        low, high = coarse * (_RING // 64), (coarse + 1) * (_RING // 64) - 1
        for arc in range(bisect_left(places, low), bisect_left(places, high) + 1):
            start = places[arc - 1] + 1 if arc else 0
            end = places[arc] if arc < len(places) else _RING - 1
            cut_cells.append((coarse, max(low, start), min(high, end), arc))
    arcs = F.broadcast(spark.createDataFrame(cut_cells, "coarse int, low long, high long, arc int"))  # a few rows for each node
    on_arc = (
        rows.withColumn("coarse", F.floor(F.col("place") / (_RING // 64)).cast("int"))
        .join(arcs, "coarse")
        .filter("place between low and high")
        .withColumn("cell", F.floor(F.col("place") / width).cast("int"))
        .select("doc_id", "size", "text_crc32", "place", "arc", "cell")
    )
    in_cell = cut(on_arc.groupBy("arc", "cell").agg(F.count("*").alias("cell_rows")))
    counts = {r["arc"]: r["n"] for r in in_cell.groupBy("arc").agg(F.sum("cell_rows").alias("n")).collect()}  # one number for each arc
    taken = assign([counts.get(a, 0) for a in range(len(owners))], owners, capacities(total, shards, slack))
    filled, intervals = [0] * shards, []
    for arc, start, end, shard in taken:
        intervals.append((arc, start, end, shard, filled[shard]))
        filled[shard] += end - start
    intervals = F.broadcast(spark.createDataFrame(intervals, "arc int, first_rank long, end_rank long, shard int, base long"))  # a few rows for each arc

    earlier = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_cell.select("arc", "cell", F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = (
        on_arc.withColumn("in_cell", F.row_number().over(within))
        .join(starts, ["arc", "cell"])
        .withColumn("rank", F.col("cell_start") + F.col("in_cell") - 1)
    )
    return (
        ranked.join(intervals, "arc")
        .filter("rank >= first_rank and rank < end_rank")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(None if slack else "rows").cast("string").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - F.col("first_rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
