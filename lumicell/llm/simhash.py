"""SimHash near-duplicate groups by deletion-variant signatures.

Method: two fingerprints that differ in at most ``k`` bits are cut into ``k // 2 + 1`` segments, so at
least one segment differs by at most one bit.  Every distinct fingerprint posts, for each segment and
each of its bits, the segment with that bit wildcarded; equal keys meet in a hash shuffle and the whole
fingerprints are verified.  Only distinct fingerprints are posted, so copies cost nothing, and a key
that more than ``bucket_rows`` distinct fingerprints share is not paired at all: its members post every
``k``-wildcard variant of the whole fingerprint instead, and whoever shares one is linked to the
smallest of them.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lumicell.llm.components import components
from lumicell.llm.shared import any_names, cut, free_name, gathered, in_small_batches, map_batches

BUCKET_ROWS = 256
_CHUNK, _LAST = 1 << 16, (1 << 63) - 1


def fingerprint(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned; zero if it has no words."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_in_shingle + 1)
    last = ends[min(words_in_shingle, len(words)) - 1 :].tolist()
    first = starts[:n].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(line[i:j], seed) for i, j in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """Rows ``(doc_id, *more, fp long)``, one for each input row; ``fp`` holds the fingerprint's bits as a signed long."""
    in_small_batches(documents.sparkSession)
    names = ["doc_id", *more]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in batch.column(len(names)).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(prints)], names=[*names, "fp"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("binary").alias("text"))
    return map_batches(narrow, run, ", ".join(f"{n} {t}" for n, t in narrow.dtypes[:-1]) + ", fp long")


def _segments(k: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of each segment."""
    m = k // 2 + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _variant_keys(k: int) -> str:
    """SQL for the one-wildcard keys of column ``fp``: one struct for each segment and each of its bits.

    ``slot`` numbers segment and wildcarded bit, ``rest`` is the segment with that bit cleared.
    """
    parts = []
    for shift, bits in _segments(k):
        mask = -1 if bits == 64 else (1 << bits) - 1
        parts.append(
            f"transform(sequence(0, {bits - 1}), i -> named_struct('slot', {shift} + i, "
            f"'rest', (shiftrightunsigned(fp, {shift}) & {mask}L) & ~shiftleft(1L, i)))"
        )
    return f"concat({', '.join(parts)})"


def _meet(k: int, bucket_rows: int):
    """Over rows sorted by ``(slot, rest)``: verified pairs ``a < b``, and ``a = b`` for members of a hot key."""

    def pairs(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        sizes = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), sizes)
        hot = sizes[group] > bucket_rows
        out = [np.stack((fp[hot], fp[hot]), 1)]
        group, fp = group[~hot & (sizes[group] > 1)], fp[~hot & (sizes[group] > 1)]
        for apart in range(1, int(sizes[sizes <= bucket_rows].max(initial=1))):
            i = np.flatnonzero(group[apart:] == group[:-apart])
            x, y = fp[i], fp[i + apart]
            close = np.bitwise_count((x ^ y).view(np.uint64)) <= k
            out.append(np.stack((np.minimum(x, y)[close], np.maximum(x, y)[close]), 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

        key, fp, hot = np.empty((0, 2), np.int64), np.empty(0, np.int64), None
        for columns in gathered(batches, _CHUNK):
            more = np.stack((columns[0].astype(np.int64), columns[1]), 1)
            more_fp = columns[2]
            if hot is not None:  # the rest of a key already known to be hot
                same = (more == hot).all(1)
                yield from emit([np.stack((more_fp[same], more_fp[same]), 1)])
                more, more_fp = more[~same], more_fp[~same]
                hot = None if len(more) else hot
            key, fp = np.concatenate((key, more)), np.concatenate((fp, more_fp))
            if not len(key):
                continue
            last = int(np.flatnonzero((key == key[-1]).all(1))[0])
            if last:
                yield from emit(pairs(key[:last], fp[:last]))
                key, fp = key[last:], fp[last:]
            if len(key) > bucket_rows:
                hot = key[0]
                yield from emit([np.stack((fp, fp), 1)])
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from emit(pairs(key, fp))

    return run


def _hot_links(hot: DataFrame, k: int) -> DataFrame:
    """Links among fingerprints of hot keys: whoever shares a ``k``-wildcard variant is linked to its smallest member."""
    masks = [sum(1 << i for i in bits) for bits in combinations(range(64), k)]
    signed = ", ".join(f"{m - (1 << 64) if m >> 63 else m}L" for m in masks)
    posted = hot.select("fp", F.explode(F.expr(f"array({signed})")).alias("mask")).withColumn("rest", F.expr("fp & ~mask"))
    least = posted.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return posted.join(least, ["mask", "rest"]).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, k: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that connect all pairs at ``k`` or fewer differing bits."""
    posted = prints.select("fp", F.explode(F.expr(_variant_keys(k))).alias("key")).select("key.slot", "key.rest", "fp")
    met = cut(
        posted.repartition("slot", "rest")
        .sortWithinPartitions("slot", "rest")
        .mapInArrow(_meet(k, bucket_rows), "a long, b long")
        .distinct()
    )
    hot = met.filter("a = b").select(F.col("a").alias("fp"))
    found = met.filter("a <> b")
    return found if hot.isEmpty() else found.union(_hot_links(hot, k))


def _rooted(prints: DataFrame, k: int, bucket_rows: int) -> DataFrame:
    """Rows ``(fp, root)``: the component of each distinct fingerprint."""
    distinct = cut(prints.select("fp").distinct())
    roots = components(links(distinct, k, bucket_rows)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each document: ``doc_id, fingerprint (16 hex digits), component_id``.

    ``component_id`` is the smallest id among the documents whose fingerprints are reachable by links of
    ``k`` or fewer differing bits.  A null or wordless text has fingerprint zero, linked like any other;
    repeated rows stay; a null id keeps its row and never becomes a component id unless the group has no
    other; an empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    rooted = _rooted(prints, k, bucket_rows).join(first, "fp")
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@any_names
def drop_near_duplicates(documents: DataFrame, k: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each group of near duplicates, all its columns as they are.

    The row with the smallest id stays, one without an id only if the group has no other; of rows with that id the one whose
    text, then whose other columns, have the smallest hash; rows equal in all columns count once.
    """
    id_name, text_hash, row_hash = (free_name(documents, n) for n in ("near_id", "near_text", "near_row"))
    plain = [F.col(f.name) if isinstance(f.dataType, AtomicType) else F.col(f.name).cast("string") for f in documents.schema.fields if f.name not in ("doc_id", "text")]
    keys = {id_name: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), text_hash: F.xxhash64("text"), row_hash: F.xxhash64(F.col("doc_id").isNull(), *plain)}
    keyed = documents.withColumns(keys)
    prints = cut(fingerprints(keyed.select(*[F.col(n).alias(a) for n, a in ((id_name, "doc_id"), (text_hash, "text_hash"), (row_hash, "row_hash"))], "text"), "text_hash", "row_hash"))
    best = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash", "row_hash")).alias("row"))  # one row for each fingerprint
    kept = _rooted(prints, k, bucket_rows).join(best, "fp").groupBy("root").agg(F.min("row").alias("row"))
    kept = kept.select(*[F.col(f"row.{a}").alias(n) for n, a in ((id_name, "doc_id"), (text_hash, "text_hash"), (row_hash, "row_hash"))])
    return keyed.join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).select(*[F.col(f"`{c}`") for c in documents.columns])
