"""Pixel rows gathered by tile: a task packs the rows that it has of a tile into one row before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import in_small_batches

#: Pixel rows that a task packs together.
PACKED = 1 << 17
_PLACE = {"y": "<i4", "x": "<i4"}


def _pieces(table: pa.Table, by: list[str], side: int, halo: int, kinds: dict[str, str]) -> pa.RecordBatch:
    """One row for each tile whose core or halo has rows of ``table``: places in the tile and values as binaries."""
    code = np.zeros(table.num_rows, np.int64)
    for c in by:
        distinct = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * (len(distinct.dictionary) + 1) + distinct.indices.to_numpy(zero_copy_only=False)
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    low, high = [(c - halo) // side for c in (y, x)], [(c + halo) // side for c in (y, x)]
    copies = []
    for a in range(int((high[0] - low[0]).max()) + 1):
        for b in range(int((high[1] - low[1]).max()) + 1):
            rows = np.flatnonzero((low[0] + a <= high[0]) & (low[1] + b <= high[1]))
            copies.append((rows, low[0][rows] + a, low[1][rows] + b))
    rows, ty, tx = (np.concatenate(c) for c in zip(*copies))
    order = np.lexsort((tx, ty, code[rows]))
    rows, ty, tx = rows[order], ty[order], tx[order]
    of = code[rows]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1]))))
    values = {"y": y[rows] - ty * side, "x": x[rows] - tx * side} | {c: table.column(c).to_numpy()[rows] for c in kinds}
    binary = []
    for c, kind in (_PLACE | kinds).items():
        ends = (np.append(first, len(rows)) * np.dtype(kind).itemsize).astype(np.int32)
        binary.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values[c], kind))]))
    owners = [table.column(c).combine_chunks().take(pa.array(rows[first])) for c in by]
    return pa.RecordBatch.from_arrays([*owners, pa.array(ty[first]), pa.array(tx[first]), *binary], names=[*by, "tile_y", "tile_x", *(_PLACE | kinds)])


def packed(rows: DataFrame, by: list[str], side: int, halo: int, kinds: dict[str, str]) -> DataFrame:
    """``by, tile_y, tile_x`` with the tile's pixels as binaries of places ``y, x`` from its corner and of the columns ``kinds``; a pixel goes to every tile whose core or halo it is in."""
    in_small_batches(rows.sparkSession)
    types, columns = dict(rows.dtypes), [*by, "y", "x", *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            if batch.num_rows:
                kept, n = [*kept, batch], n + batch.num_rows
            if n >= PACKED:
                yield _pieces(pa.Table.from_batches(kept), by, side, halo, kinds)
                kept, n = [], 0
        if kept:
            yield _pieces(pa.Table.from_batches(kept), by, side, halo, kinds)

    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "tile_y long, tile_x long", *(f"{c} binary" for c in (_PLACE | kinds))])
    return rows.select(*columns).mapInArrow(run, schema)


def by_tile(pieces: DataFrame, by: list[str], side: int, kinds: dict[str, str], run: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, more: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """``run((*by, tile_y, tile_x), pixels)`` for each tile; ``more`` may add columns to the tiles' rows, whose values then follow in the key."""
    columns = _PLACE | kinds
    met = more(pieces.groupBy(*by, "tile_y", "tile_x").agg(F.collect_list(F.struct(*columns)).alias("pieces")))
    keys = [*by, "tile_y", "tile_x", *(c for c in met.columns if c not in (*by, "tile_y", "tile_x", "pieces"))]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for *key, pieces_of in frame.itertuples(index=False, name=None):
                got = {c: np.concatenate([np.frombuffer(p[c], kind) for p in pieces_of]) for c, kind in columns.items()}
                corner = dict(zip(keys, key))
                yield run(tuple(key), pd.DataFrame(got | {"y": got["y"] + np.int64(corner["tile_y"] * side), "x": got["x"] + np.int64(corner["tile_x"] * side)}))

    return met.select(*keys, "pieces").mapInPandas(each, schema)
