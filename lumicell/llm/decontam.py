"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some token positions of a window and ignore the others, so a substituted word only
spoils the windows in which it stands at a position that counts.  Hashes of the benchmark's windows are
joined with those of every document window; each hit names an item and an alignment, and the words around
it are compared one by one: the best run along the alignment, with a match counting 1 and a substitution
-2, must hold enough matching words.

Items of up to ``SHORT`` words have seeds of their own: of an item that may lose r words, every (r + 1)-th position makes one
seed, so one of the r + 1 seeds has no substituted word whatever they are, and no overlap of a short item is missed.  Longer
items are searched by three masks at every position.

Hits that go on along an alignment count once: a window is looked up together with the one before it, and those item
windows are passed over whose predecessor is the same too.  So a text of one repeated word takes time in proportion to its length.

Equal items are searched once.  The benchmark is joined from a broadcast index of about ``BLOCK_WORDS`` words; a larger one is
cut into that many blocks by a hash of the text, each block passes over all documents, and its result is stored before the next.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import any_names, cut, free_name, in_small_batches, map_batches

#: 1: the token counts; 0: it may differ.
MASKS = ("11101011", "1100110101", "10110010111")
#: Matching words that make an overlap, and the part of a shorter item that does.
LEAST_WORDS, LEAST_PART = 13, 0.8
#: The longest items with seeds of their own.
SHORT = 16
BLOCK_WORDS = 1 << 20
_WORD = re.compile(r"\w+")
_FILTER_BITS = 22
#: Words and hits worked on at once.
_TOGETHER, _HITS = 1 << 18, 1 << 20
_NONE = np.uint64(0)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def needed(length: int) -> int:
    """Matching words that make an overlap with an item of so many words."""
    return min(LEAST_WORDS, math.ceil(LEAST_PART * length - 1e-9))


def short_seeds(length: int) -> list[range]:
    """Positions of each seed of a short item; one seed is whole if the item has no more than ``length - needed(length)`` substitutions."""
    seeds = length - needed(length) + 1
    return [range(first, length, seeds) for first in range(seeds)]


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """``(matching words, start, end)`` of the run with the largest sum of +1 for a match and -2 for a difference; the longest of equals."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    start = int(np.flatnonzero(total[: end + 1] == least[end])[0])
    return int(same[start:end].sum()), start, end


def window_hashes(tokens: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """The hash of the tokens at ``offsets`` from each position that has them all; never 0."""
    n = len(tokens) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 0x9E3779B97F4A7C15
    tokens = tokens.astype(np.uint64)
    for o in offsets:
        factor = (factor * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % (1 << 64) | 1
        total += tokens[o : o + n] * np.uint64(factor)
    return np.maximum(total * np.uint64(0xD6E8FEB86659FD93) ^ (total >> np.uint64(29)), np.uint64(1))


def _pair(own: np.ndarray, before: np.ndarray) -> np.ndarray:
    return own * np.uint64(0x9E3779B97F4A7C15) ^ before


class Seeds:
    """Item windows of one seed by their hash and that of the window before them."""

    def __init__(self, own: np.ndarray, before: np.ndarray, item: np.ndarray, position: np.ndarray):
        order = np.lexsort((before, own))
        self.own, before, self.item, self.position = own[order], before[order], item[order], position[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[own >> np.uint64(64 - _FILTER_BITS)] = True
        new = np.flatnonzero(np.concatenate(([True], (self.own[1:] != self.own[:-1]) | (before[1:] != before[:-1]))))
        pairs, ends = _pair(self.own[new], before[new]), np.append(new[1:], len(order))
        by_pair = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_low, self.pair_high = pairs[by_pair], new[by_pair], ends[by_pair]

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(place among the hashes, entry)`` of every hit that does not go on from the place before."""
        near = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        low, high = np.searchsorted(self.own, hashes[near], "left"), np.searchsorted(self.own, hashes[near], "right")
        near, low, high = (x[high > low] for x in (near, low, high))
        if not len(near):
            return
        before = np.where(near > 0, hashes[near - 1], _NONE)
        pair = _pair(hashes[near], before)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        goes_on = (self.pairs[at] == pair) & (before != _NONE)
        from_, to = np.where(goes_on, self.pair_low[at], low), np.where(goes_on, self.pair_high[at], low)
        near, start, end = np.concatenate((near, near)), np.concatenate((low, to)), np.concatenate((from_, high))
        many = end - start
        near, start, many = near[many > 0], start[many > 0], many[many > 0]
        through = np.cumsum(many)
        done = 0
        while done < len(many):
            upto = max(done + 1, int(np.searchsorted(through, (through[done - 1] if done else 0) + _HITS, "right")))
            n, first = many[done:upto], start[done:upto]
            yield np.repeat(near[done:upto], n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            done = upto


class SeedIndex:
    """Window hashes of a bounded block of benchmark items ``(key, words)``."""

    def __init__(self, items: list[tuple[int, list[str]]], masks: tuple[str, ...] = MASKS):
        self.ids: dict[str, int] = {}
        self.items = [(item, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in ws], np.int64)) for item, ws in items]
        found: dict[tuple[int, ...], list] = defaultdict(list)
        spaced = [tuple(i for i, c in enumerate(mask) if c == "1") for mask in masks]
        for at, (_, tokens) in enumerate(self.items):
            if len(tokens) <= SHORT:
                for seed in short_seeds(len(tokens)):
                    offsets = tuple(i - seed[0] for i in seed)
                    own = window_hashes(tokens[seed[0] : seed[-1] + 1], offsets)
                    found[offsets].append((own, np.zeros(1, np.uint64), np.array([at]), np.array([seed[0]])))
            else:
                for offsets in spaced:
                    own = window_hashes(tokens, offsets)
                    found[offsets].append((own, np.concatenate((np.zeros(1, np.uint64), own[:-1])), np.full(len(own), at), np.arange(len(own))))
        self.seeds = [(offsets, Seeds(*(np.concatenate(x) for x in zip(*rows)))) for offsets, rows in found.items()]
        self.gap = 1 + max((offsets[-1] for offsets in found), default=0)

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """``(row, item, matching words, item words, start word, end word)``: the best overlap of each row with each item."""
        get = self.ids.get
        out, tokens, first, size = [], [], 0, 0
        for row, text in enumerate(texts):
            tokens.append(np.array([get(w, 0) for w in words(text)], np.int64))
            size += len(tokens[-1])
            if size >= _TOGETHER or row == len(texts) - 1:
                out += [(first + r, *rest) for r, *rest in self._overlaps(tokens)]
                tokens, first, size = [], row + 1, 0
        return out

    def _overlaps(self, tokens: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        gap = np.zeros(self.gap, np.int64)
        starts = np.cumsum([0, *(len(t) + len(gap) for t in tokens)])
        line = np.concatenate([x for t in tokens for x in (t, gap)])
        aligned = set()
        for offsets, seeds in self.seeds:
            for at, entry in seeds.hits(window_hashes(line, offsets)):
                row = np.searchsorted(starts, at, "right") - 1
                aligned.update(map(tuple, np.unique(np.stack((row, seeds.item[entry], at - starts[row] - seeds.position[entry]), 1), axis=0).tolist()))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, shift in sorted(aligned):
            doc, own = tokens[row], self.items[item][1]
            if best.get((row, item), (0,))[0] == len(own):
                continue  # no alignment has more
            low, high = max(0, shift), min(len(doc), shift + len(own))
            n, start, end = best_run(doc[low:high] == own[low - shift : high - shift])
            if n >= needed(len(own)):
                best[row, item] = max(best.get((row, item), (0, 0, 0)), (n, low + start, low + end))
        return [(row, self.items[item][0], n, len(self.items[item][1]), a, b) for (row, item), (n, a, b) in sorted(best.items())]


def _items(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Distinct texts with their keys, and in how many blocks they go."""
    texts = benchmark.filter("text is not null").select(F.xxhash64("text").alias("key"), "text").distinct()
    texts = cut(texts.filter(F.col("text").rlike("\\w")))
    size = texts.agg(F.sum(F.size(F.split("text", "\\W+")))).first()[0] or 0
    return texts, -(-size // block_words)


def _index(texts: DataFrame, block: int, blocks: int, masks: tuple[str, ...]):
    rows = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()  # about block_words words
    found = [(r["key"], ws) for r in sorted(rows, key=lambda r: r["key"]) if (ws := words(r["text"]))]
    return texts.sparkSession.sparkContext.broadcast(SeedIndex(found, masks))


def contaminated(documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``(doc_id, item_id, matched_words, item_words, first_word, end_word)`` for documents that hold benchmark text.

    A document overlaps an item if a run along one alignment has 13 matching words, or four fifths of a
    shorter item's words, with at most every third word substituted; an item of up to four words must stand there whole.  Null,
    empty and clean texts give no rows; items that are null or have no words overlap nothing; items with equal texts all have
    rows; rows with one ``doc_id`` give their best overlap; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    in_small_batches(spark)
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, key long, matched_words long, item_words long, first_word long, end_word long"
    found = spark.createDataFrame([], schema)
    texts, blocks = _items(benchmark, block_words)
    for block in range(blocks):
        index = _index(texts, block, blocks, masks)

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], *rest) for r, *rest in index.value.overlaps(batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.replace(" long", "").split(", "))

        more = map_batches(narrow, run, schema)
        if blocks > 1:
            more = cut(more)
            index.unpersist()
        found = found.union(more)
    best = found.groupBy("doc_id", "key").agg(F.max(F.struct("matched_words", "item_words", "first_word", "end_word")).alias("best"))
    named = benchmark.filter("text is not null").select(F.xxhash64("text").alias("of"), F.col("item_id").cast("long").alias("item_id")).distinct()
    return best.join(named, best.key == named.of).select("doc_id", "item_id", "best.*")


@any_names
def decontaminate(documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no benchmark text, all their columns as they are.

    With one block of items nothing is shuffled; with more, documents are stored with row numbers and those that a block
    finds are taken out by number.
    """
    in_small_batches(documents.sparkSession)
    texts, blocks = _items(benchmark, block_words)
    if not blocks:
        return documents
    if blocks == 1:
        index, at = _index(texts, 0, 1, masks), documents.columns.index("text")

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = {row for row, *_ in index.value.overlaps(batch.column(at).to_pylist())}
            return batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))

        return map_batches(documents, keep, documents.schema)
    number = free_name(documents, "decontam_row")
    numbered = cut(documents).withColumn(number, F.monotonically_increasing_id())
    narrow = numbered.select(F.col(number).alias("hit_row"), "text")
    clean = numbered
    for block in range(blocks):
        index = _index(texts, block, blocks, masks)

        def hits(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows = sorted({row for row, *_ in index.value.overlaps(batch.column(1).to_pylist())})
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))], names=["hit_row"])

        found = cut(map_batches(narrow, hits, "hit_row long"))
        index.unpersist()
        clean = clean.join(found, F.col(number) == F.col("hit_row"), "left_anti")
    return clean.drop(number)
