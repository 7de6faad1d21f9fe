"""Substring dedup by seed and extend: stretches of ``least`` words that stand elsewhere before are removed.

Seeds: of the ``gram``-word hashes in every window of ``least`` words the smallest (the last of equals) is the window's anchor.  It depends
on the window's words only, so equal windows have the same anchor at the same place; neighbouring windows mostly share theirs, so there
is about one anchor for ``(least - gram + 2) / 2`` words.  Occurrences are joined on their anchors' hashes, and those that stand once drop out;
most do, so only hashes and numbers of all anchors are shuffled, and texts are looked at again where an anchor is shared.

Extending: an anchor's *reach* is the stretch of all windows that chose it, extended from the anchor both ways.  Of equal reaches the first
keeps its windows, the others are repeats as a whole, however many there are.  Anchors with several reaches (where copies begin, end or
differ) are extended window by window: the first occurrence of every reach offers its windows, and each is kept where it stands first.
Both steps are sums with a minimum in every task, so a passage in a third of all documents costs each task one row, and no pairs of
occurrences are formed.  Windows of shared anchors that nothing keeps are repeats; overlapping ones are one maximal repeat.

Words and stretches are equal if their 64-bit hashes are; windows are compared by two such hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import cut, free_name, in_small_batches, map_batches, remove_folder, shared_folder
from lumicell.llm.words import Stretches, Words

LEAST, GRAM = 20, 8
_KEY = ["no_id", "id", "text_key"]


def _last_least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest of ``width`` values from each position on, the last of equals."""
    at, have = np.arange(len(values)), 1

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    while have < width:
        step = min(have, width - have)
        at, have = later(at[:-step], at[step:]), have + step
    return at


def anchors_of(words: np.ndarray, texts: np.ndarray, least: int, gram: int) -> dict[str, np.ndarray]:
    """For each anchor of each text: ``text``, ``start`` (a position among all words) and number of its ``windows``, and hashes ``anchor`` and ``reach``."""
    n = len(words) - least + 1
    if n <= 0:
        return dict.fromkeys(("text", "start", "windows", "anchor", "reach"), np.empty(0, np.int64))
    stretches, at = Stretches(words), np.arange(len(words) - gram + 1)
    grams = stretches.hashes(at, at + gram)
    anchor = _last_least(grams, least - gram + 1)
    window = np.flatnonzero(texts[:n] == texts[least - 1 :])
    if not len(window):
        return anchors_of(words[:0], texts[:0], least, gram)
    anchor = anchor[window]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    start, windows = window[first], np.diff(np.append(first, len(window)))
    return {"text": texts[start], "start": start, "windows": windows, "anchor": grams[anchor[first]], "reach": stretches.hashes(start, start + windows + least - 1)}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _keyed(documents: DataFrame, id_name: str, text_name: str, *more) -> DataFrame:
    """The order of documents (smaller ids first, rows without one last, of one id by the text's hash), one hash of it, and the text's bytes."""
    doc_id, text = (F.col(f"`{n}`") for n in (id_name, text_name))
    key = [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_key")]
    return documents.select(F.xxhash64(*key).alias("doc"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"), *key, *more)


def _anchors(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """Rows ``(doc, anchor, start)``: every anchor of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        found = anchors_of(words.hashes(), words.text_of(), least, gram)
        start = found["start"] - words.first[found["text"]]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found["text"])), _signed(found["anchor"]), pa.array(start.astype(np.int32))], names=["doc", "anchor", "start"])

    return map_batches(texts.select("doc", "text"), run, "doc long, anchor long, start int")


def _reaches(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The anchors that begin at the places ``starts`` of each text, with their reach and the hash of each of their windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, lists = Words(batch.column(1)), batch.column(5)
        hashes = words.hashes()
        found = anchors_of(hashes, words.text_of(), least, gram)
        asked = words.first[np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))] + lists.flatten().to_numpy(zero_copy_only=False)
        text, start, windows, anchor, reach = (found[c][np.isin(found["start"], asked)] for c in ("text", "start", "windows", "anchor", "reach"))
        begin = np.cumsum(windows) - windows
        at = np.repeat(start - begin, windows) + np.arange(windows.sum())
        each = pa.ListArray.from_arrays(pa.array(np.append(begin, windows.sum()).astype(np.int32)), _signed(Stretches(hashes).hashes(at, at + least)))
        of = pa.array(text)
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in (2, 3, 4)), pa.array((start - words.first[text]).astype(np.int32)), _signed(anchor), _signed(reach), each], names=[*_KEY, "start", "anchor", "reach", "windows"])

    return map_batches(texts, run, "no_id boolean, id long, text_key long, start int, anchor long, reach long, windows array<long>")


def shared_windows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row for each document with shared anchors: ``no_id, id, text_key, list``.

    An item of ``list`` is a stretch of windows, in one number: its first window, times 2^16 with how many they are, doubled, with 1 added where they
    stand nowhere before.  All stretches of shared anchors are listed, and again those that stand nowhere before.
    """
    texts = _keyed(documents, id_column, text_column)
    shared = _anchors(texts, least, gram).groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    starts = _anchors(texts, least, gram).join(shared, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("start").alias("starts"))  # at most a document's anchors, however often its row is repeated
    spark, folder = documents.sparkSession, f"{shared_folder(documents.sparkSession)}/reaches-{uuid.uuid4()}"
    _reaches(texts.join(starts, "doc"), least, gram).write.parquet(f"{folder}/all")
    found = spark.read.parquet(f"{folder}/all")

    first = F.min(F.struct(*_KEY, "start")).alias("at")
    found.groupBy("anchor", "reach").agg(first, F.first("windows").alias("windows")).write.parquet(f"{folder}/first")  # equal reaches have equal windows
    reaches = spark.read.parquet(f"{folder}/first")
    several = reaches.groupBy("anchor").agg((F.count("*") > 1).alias("several"))
    one = reaches.select("anchor", "at.*", F.size("windows").alias("windows")).join(several.filter("not several"), "anchor")
    offered = reaches.join(several.filter("several"), "anchor").select("anchor", "at", F.posexplode("windows").alias("place", "window"))
    offered = offered.select("anchor", "window", *[f"at.{k}" for k in _KEY], (F.col("at.start") + F.col("place")).alias("start"))
    single = offered.groupBy("anchor", "window").agg(first).select("at.*", F.lit(1).alias("windows"))
    told = lambda df, nowhere: df.select(*_KEY, ((F.col("start").cast("long") * (1 << 16) + F.col("windows")) * 2 + nowhere).alias("item"))
    every = told(found.select(*_KEY, "start", F.size("windows").alias("windows")), 0).unionByName(told(one, 1)).unionByName(told(single, 1))
    lists = cut(every.groupBy(*_KEY).agg(F.collect_set("item").alias("list")))  # at most a document's windows
    remove_folder(spark, folder)
    return lists


def remove(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Every row with ``n_words``, ``n_removed``, ``repeats`` (structs ``start, end`` in words: its maximal repeats) and ``kept``, the other words.

    A word goes if a window of ``least`` words over it stands earlier too: in a document with a smaller id, or before in its own.  Windows are
    judged on the input.  Null, empty and short texts keep all their words.  Rows without an id come last; rows of one id follow each other
    by the text's hash, and rows equal in both are one document, so each has the same result.  New columns get underscores where names are taken.
    """
    in_small_batches(documents.sparkSession)
    lists = shared_windows(documents, id_column, text_column, least, gram)
    names = documents.columns
    new = [free_name(documents, n) for n in ("n_words", "n_removed", "repeats", "kept")]
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_column)}"
    rest = F.struct(F.col(text).isNull().alias("no_text"), *[F.col(c) for c in plain.columns if c != text])  # the text goes once
    sent = _keyed(plain, f"c{names.index(id_column)}", text, rest.alias("row")).join(lists, _KEY, "left").select("row", "text", "list")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, lists = Words(batch.column(1)), batch.column(2)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        item = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start, windows = item >> 17, item >> 1 & 0xFFFF
        weight = np.where(item & 1, 1 << 32, 1)  # shared windows count in the low half, first ones in the high half
        spans, texts, removed = [], [], []
        for i, n in enumerate(words.counts().tolist()):
            here = slice(offsets[i], offsets[i + 1])
            seen = np.zeros(max(0, n - least + 1) + 1, np.int64)
            np.add.at(seen, start[here], weight[here])
            np.add.at(seen, start[here] + windows[here], -weight[here])
            seen = np.cumsum(seen)[:-1]
            again = np.concatenate(([0], (seen > 0) & (seen < 1 << 32), [0])).astype(np.int8)  # windows that stand earlier too
            edge = np.flatnonzero(np.diff(again)).reshape(-1, 2) + [0, least - 1]
            if len(edge):  # stretches of windows may overlap
                gap = np.flatnonzero(edge[1:, 0] > edge[:-1, 1])
                edge = np.stack((edge[np.append(0, gap + 1), 0], edge[np.append(gap, len(edge) - 1), 1]), 1)
            keep = np.ones(n, bool)
            for a, b in edge.tolist():
                keep[a:b] = False
            spans.append([{"start": a, "end": b} for a, b in edge.tolist()])
            removed.append(n - int(keep.sum()))
            texts.append(words.kept(i, keep))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.counts().astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary())], names=["row", "text", "n_words", "n_removed", "repeats", "kept"])

    schema = f"row {sent.schema['row'].dataType.simpleString()}, text binary, n_words long, n_removed long, repeats array<struct<start: long, end: long>>, kept binary"
    own = [F.when(~F.col("row.no_text"), F.col("text").cast("string")) if c == text else F.col(f"row.{c}") for c in plain.columns]
    return map_batches(sent, run, schema).select(*own, "n_words", "n_removed", "repeats", F.col("kept").cast("string")).toDF(*names, *new)


#: The same in DuckDB: every window as text.
REMOVE_SQL = r"""
WITH split AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc, i, array_to_string(words[i:i + 19], ' ') AS words FROM (SELECT doc, words, unnest(range(1, len(words) - 18)) AS i FROM split)),
again AS (SELECT doc, i FROM (SELECT doc, i, row_number() OVER (PARTITION BY words ORDER BY doc, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc, i + k AS i FROM again CROSS JOIN range(20) AS r(k)),
word AS (SELECT doc, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM split),
kept AS (SELECT doc, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc, i) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc)
"""
