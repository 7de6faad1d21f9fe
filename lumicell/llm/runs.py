"""Runs: maximal stretches of a text that repeat with a period, by enumerating maximal pairs.

A run of smallest period q and length L holds the same words at its start and q words later, for L - q words, and neither can be
extended: to the left and to the right of the two copies stand different words.  So runs of at least ``least_exponent`` periods
are the *maximal pairs* whose distance q is at most their length divided by ``least_exponent - 1``; nothing has to be extended.

Maximal pairs are read from the suffix array of a text.  Its LCP intervals are walked bottom-up; an interval's leaf list holds its
positions in order, each with its left word as its class.  Where two children meet, both copies agree for exactly the interval's
length (so they differ on the right), and a position of the smaller list is compared with its neighbours in the larger one if their classes
differ (so they differ on the left).  Neighbours are enough: with another occurrence in between, the period would not be the smallest.
Children whose lists are of one and the same class are joined without a look; parts of the tree with one class are not walked at all.

Lists are merged from the smaller into the larger, so a text of n words takes O(n log^2 n) time, whatever it repeats, and memory in
proportion to n.  Texts without a repeated window of the shortest possible length have no run and no suffix array.

Each row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import free_name, in_small_batches, map_batches
from lumicell.llm.words import Stretches, Words, mix


def _order(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share at least ``window`` words with another, in order, and where their group of ``window`` equal words begins.

    Prefixes of 1, 2, 4 words and so on are ranked in turn; a rank is the number of suffixes before the group, so groups that have
    only one member are settled and left alone.
    """
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    active = np.arange(n)
    sort = np.argsort(rank, kind="stable")
    active, h = active[sort], 1
    rank = np.searchsorted(rank[sort], rank)
    shared = group = None
    while True:
        if h == window:
            shared, group = np.sort(active), rank.copy()
        if not len(active):
            break
        reach = active + h
        second = np.where(reach < n, rank[np.minimum(reach, n - 1)] + 1, 0)
        key = rank[active] * np.int64(n + 2) + second
        sort = np.argsort(key, kind="stable")
        active, key = active[sort], key[sort]
        old = rank[active]
        place = np.arange(len(active))
        new_old, new_key = np.concatenate(([True], old[1:] != old[:-1])), np.concatenate(([True], key[1:] != key[:-1]))
        before, within = np.maximum.accumulate(np.where(new_old, place, 0)), np.maximum.accumulate(np.where(new_key, place, 0))
        rank[active] = old + within - before
        active = active[~(new_key & np.concatenate((new_key[1:], [True])))]
        h *= 2
    if shared is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = shared[np.argsort(rank[shared], kind="stable")]
    return shared, group[shared]


def _common(stretches: Stretches, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many words from a and from b on are the same."""
    length = np.zeros(len(a), np.int64)
    for step in (1 << k for k in reversed(range(max(1, n).bit_length()))):
        x, y = a + length, b + length
        fits = np.flatnonzero(np.maximum(x, y) + step <= n)
        x, y = x[fits], y[fits]
        length[fits[stretches.hashes(x, x + step) == stretches.hashes(y, y + step)]] += step
    return length


def _merge(one: tuple[list, int | None], other: tuple[list, int | None], common: int, left: dict[int, int], pairs: list, exponent: int) -> tuple[list, int | None]:
    """The leaf list of both; appends ``(start, distance, common)`` of maximal pairs whose distance is short enough.

    A list is ``(positions in order, their class or None if they have several)``.
    """
    (small, a), (large, b) = sorted((one, other), key=lambda x: len(x[0]))
    same = a is not None and a == b
    if not same:
        furthest = common // (exponent - 1)
        for x in small:
            i, c = bisect_left(large, x), left[x]
            for y in large[max(0, i - 1) : i + 1]:
                if abs(x - y) <= furthest and left[y] != c:
                    pairs.append((min(x, y), abs(x - y), common))
    if len(small) * 8 < len(large):
        for x in small:
            insort(large, x)
    else:
        large.extend(small)
        large.sort()
    return large, a if same else None


def maximal_pairs(order: list[int], common: list[int], left: dict[int, int], exponent: int) -> list[tuple[int, int, int]]:
    """The bottom-up walk over suffixes ``order``; ``common[i]`` is the number of words that suffixes i - 1 and i share."""
    pairs: list[tuple[int, int, int]] = []
    stack: list[tuple[int, tuple]] = []
    now: tuple[list, int | None] = ([order[0]], left[order[0]])
    for i in range(1, len(order)):
        while stack and stack[-1][0] > common[i]:
            length, held = stack.pop()
            now = _merge(held, now, length, left, pairs, exponent)
        if stack and stack[-1][0] == common[i]:
            now = _merge(stack.pop()[1], now, common[i], left, pairs, exponent)
        stack.append((common[i], now))
        now = ([order[i]], left[order[i]])
    while stack:
        length, held = stack.pop()
        now = _merge(held, now, length, left, pairs, exponent)
    return pairs


def runs_of(words: np.ndarray, texts: np.ndarray, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int, int]]:
    """``(text, start, length, period)`` of every run, by text, start and period.

    ``words`` are hashes of the words of all texts, ``texts`` the number of each word's text; starts are counted in the text.
    A run has at least ``least`` words and ``exponent`` periods (2 or more).
    """
    # A run's two copies share length - q words, with q at most length / exponent.
    shortest = max(1, least - least // exponent)
    window = 1 << (shortest.bit_length() - 1)
    words = mix(words ^ mix(texts.astype(np.uint64) + np.uint64(1)))  # words of different texts differ
    start = np.arange(max(0, len(words) - window + 1))
    start = start[texts[start] == texts[start + window - 1]]
    seen = Stretches(words).hashes(start, start + window)
    sort = np.argsort(seen)
    again = np.flatnonzero(seen[sort][1:] == seen[sort][:-1])
    some = np.unique(texts[start[sort[again]]])  # texts with a repeated window
    if not len(some):
        return []
    where = np.flatnonzero(np.isin(texts, some))
    words, texts = words[where], texts[where]
    new = np.concatenate(([True], texts[1:] != texts[:-1]))
    # A word of its own before each text and at the end, so no stretch goes on past a text.
    place = np.arange(len(words)) + np.cumsum(new)
    values = mix(np.arange(len(words) + len(some) + 1, dtype=np.uint64) + np.uint64(1 << 40))
    values[place] = words
    text_at = np.zeros(len(values), np.int64)
    text_at[place] = texts
    begin = dict(zip(texts[new].tolist(), place[new].tolist()))
    order, group = _order(values, window)
    if not len(order):
        return []
    left = values[order - 1]
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    number = np.cumsum(new_group) - 1
    mixed = np.bincount(number[1:], (left[1:] != left[:-1]) & ~new_group[1:], minlength=number[-1] + 1) > 0
    chosen = mixed[number]  # groups of one class hold no maximal pair
    order, left, number = order[chosen], left[chosen], number[chosen]
    if not len(order):
        return []
    inside = np.flatnonzero(number[1:] == number[:-1]) + 1
    common = np.zeros(len(order), np.int64)
    common[inside] = _common(Stretches(values), order[inside - 1], order[inside], len(values))
    edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(order)]
    found: dict[tuple[int, int], int] = {}
    for a, b in zip(edges, edges[1:]):
        part = order[a:b].tolist()
        for s, q, length in maximal_pairs(part, common[a:b].tolist(), dict(zip(part, left[a:b].tolist())), exponent):
            if length + q >= least:
                key = (s, length + q)
                found[key] = min(q, found.get(key, q))  # the same stretch at a multiple of its period
    rows = [(int(text_at[s]), s, length, q) for (s, length), q in found.items()]
    return sorted(((t, s - begin[t], length, q) for t, s, length, q in rows), key=lambda r: (r[0], r[1], r[3]))


def find(documents: DataFrame, text_column: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """Every row with ``runs`` (structs ``start, length, period`` in words, by start, then period) and ``collapsed``, the text in which of each run only
    the first period remains, one space between words.  The new columns get underscores where the names are taken; other columns stay.

    A null, empty or blank text has no runs and an empty ``collapsed``; repeated rows each get their own; no rows give no rows.
    """
    in_small_batches(documents.sparkSession)
    runs_name, collapsed_name = free_name(documents, "runs"), free_name(documents, "collapsed")
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # any name passes
    text = f"c{names.index(text_column)}"
    sent = plain.select("*", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("words"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(len(names)))
        texts = words.text_of()
        runs: list[list] = [[] for _ in range(batch.num_rows)]
        keep: list[np.ndarray | None] = [None] * batch.num_rows
        for t, s, length, q in runs_of(words.hashes(), texts, least, exponent) if len(texts) else []:
            runs[t].append({"start": s, "length": length, "period": q})
            if keep[t] is None:
                keep[t] = np.ones(words.first[t + 1] - words.first[t], bool)
            keep[t][s + q : s + length] = False
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        collapsed = pa.array([words.kept(i, keep[i]) for i in range(batch.num_rows)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(runs, kind), collapsed], names=[*batch.schema.names[: len(names)], "runs", "collapsed"])

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    found = map_batches(sent, run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string")).toDF(*names, runs_name, collapsed_name)


def periodic(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, of which one in ten (by CRC-32 of the id) is made to repeat: words from place a on follow in a period p.

    With h the CRC-32, g = h div 10 and n words: a = g % n and p = 1 + (n - a) div (3 + g % 8).  Rows without an id stay as they are.
    """
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    parts = (
        f"transform(array(named_struct('w', {words}, 'g', h div 10)), s -> named_struct('w', s.w, 'a', if(size(s.w) > 0, s.g % size(s.w), 0), 'd', 3 + s.g % 8))",
        "transform(parts, s -> named_struct('w', s.w, 'a', s.a, 'p', 1 + (size(s.w) - s.a) div s.d))[0]",
        "array_join(transform(part.w, (w, i) -> if(i < part.a, w, part.w[cast(part.a + (i - part.a) % part.p as int)])), ' ')",
    )
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("h", F.expr("crc32(cast(cast(doc_id as string) as binary))"))
    made = hashed.withColumn("parts", F.expr(f"case when h % 10 = 0 then {parts[0]} end")).withColumn("part", F.expr(parts[1]))
    return made.withColumn("text", F.expr(f"case when size(part.w) > 0 then {parts[2]} else text end")).select("doc_id", "text")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run with the most periods (the first of equals) and hashes of all runs and of the collapsed text."""
    best = "aggregate(runs, runs[0], (a, r) -> if(r.length * a.period > a.length * r.period, r, a))"
    return found.withColumn("best", F.expr(f"case when size(runs) > 0 then {best} end")).selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period", "1000 * best.length div best.period as exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
