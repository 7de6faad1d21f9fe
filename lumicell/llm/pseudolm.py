"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every word of every document is predicted from the two words on either side, by a hierarchical softmax: words
lie in order of frequency on a line, each as long as its share of the corpus, and the line is halved again and
again.  At every halving the network says on which side the word is, from the embeddings of the words around
it; ``LEVELS`` halvings give one of 65,535 cells.  A cell that holds one word ends there; in a cell that rare words
share, the corpus counts give the word.  All steps are normalised, so a document's score is a sum of conditional
log-probabilities over all words of the corpus.

Counts of words are a table in the cluster.  Only words that are at least one in ``HEAD`` of the corpus (so at most ``HEAD``
words) go to the driver and into the broadcast model; the others get their cell by hash, and a join brings their
own counts to the documents that hold them.

Every window of every document trains the network, in every round: runs of words are dealt over tasks of a
bounded size by a hash of their document, each task trains a copy of the network, and every row of the copies
is averaged by how often they touched it.  Runs are sorted before training, so the same documents give the same scores, up to
rounding of single precision, however they are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import cut, in_small_batches, map_batches

#: Halvings of the line, cells (the last code stands for what is beyond a text), width of embeddings.
LEVELS, CELLS, EDGE, WIDTH = 16, (1 << 16) - 1, (1 << 16) - 1, 11
OFFSETS = (-2, -1, 1, 2)
#: Words rarer than one in ``HEAD`` share cells by hash.
HEAD = 1 << 20
#: Windows of one training task; rounds of averaging.  Each round trains on all windows.
TASK_WINDOWS, ROUNDS = 3_000_000, 1
RATE = 0.2
_RUN, _REACH, _TOP = 64, 2, 7
_TOP_NODES = (1 << _TOP) - 1
_BATCH_RUNS, _SCORE_RUNS, _CHUNK, _HELD, _CHUNK_BYTES = 96, 64, 8192, 2_000_000, 1 << 19
#: Copies that one task averages, and row ranges that a copy is sent in.
_MEET, _PIECES = 8, 16
_UNSEEN = 0.5


#: What each byte counts in a word's hash: A-Z as a-z, and nothing for the six ASCII spaces.
_BYTES = np.arange(1, 257, dtype=np.uint64)
_BYTES[65:91] += np.uint64(32)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(64, _FACTOR, np.uint64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(63-bit hash of each word, number of words of each text)`` of UTF-8 texts; words are told apart by their hashes.

    Words end at ASCII spaces; A-Z count as a-z.  A hash is a polynomial of the bytes, well mixed.
    """
    global _POWERS
    line = _BYTES[np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)]
    inside = line != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(line) and inside[0]:
        starts = np.concatenate(([0], starts))
    many = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t or b"") + 1 for t in texts)])))
    if not len(starts):
        return np.empty(0, np.int64), many
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    while len(_POWERS) <= (ends - starts).max():
        _POWERS = np.concatenate((_POWERS, _POWERS * _POWERS[-1]))
    letters = np.flatnonzero(inside)
    place = letters - np.repeat(starts, ends - starts)
    sums = np.add.reduceat(line[letters] * _POWERS[place], np.cumsum(ends - starts) - (ends - starts))
    sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((sums ^ (sums >> np.uint64(32))) >> np.uint64(1)).view(np.int64), many


@dataclass
class Vocabulary:
    """Cells of words.  ``heads`` are hashes of the frequent words, sorted, with ``cells`` and log-shares ``within`` them.

    Other words fall by hash on the cells from ``first`` on.  ``mass`` is the number of words in each cell, all counted.
    """

    heads: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cells: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint16))
    within: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    first: int = 0
    mass: np.ndarray = field(default_factory=lambda: np.zeros(CELLS))

    def tail_cells(self, hashed: np.ndarray) -> np.ndarray:
        return (self.first + ((hashed >> 32) * (CELLS - self.first) >> 31)).astype(np.uint16)

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Where each word is among the heads, or -1.  The leading bits of a hash tell about where to look."""
        if not len(self.heads):
            return np.full(len(hashed), -1)
        bits = max(1, int(len(self.heads)).bit_length() + 1)
        if "_first" not in self.__dict__:
            self.__dict__["_first"] = np.searchsorted(self.heads >> (63 - bits), np.arange(1 << bits)).astype(np.int32)
        at = self.__dict__["_first"][hashed >> (63 - bits)]
        out = np.full(len(hashed), -1)
        left = np.arange(len(hashed))
        while len(left):  # a few heads share their leading bits
            here = np.minimum(at[left], len(self.heads) - 1)
            found = self.heads[here]
            hit = found == hashed[left]
            out[left[hit]] = here[hit]
            left = left[(found < hashed[left]) & (at[left] < len(self.heads) - 1)]
            at[left] += 1
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_first"}

    def coded(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(cell of each word, its log-share in the cell, whether it is a head)``; of others the share of one word."""
        place = self.places(hashed)
        head = place >= 0
        cells, each = np.empty(len(hashed), np.uint16), np.empty(len(hashed))
        cells[head], each[head] = self.cells[place[head]], self.within[place[head]]
        cells[~head] = self.tail_cells(hashed[~head])
        each[~head] = -np.log(np.maximum(self.mass[cells[~head]], 1.0))
        return cells, each, head


def _groups(columns: list[list], sizes: list[int]) -> Iterator[list[list]]:
    """Rows of a batch, some at a time, by the sizes of their texts."""
    first = total = 0
    for at, size in enumerate(sizes):
        total += size
        if total > _CHUNK_BYTES or at == len(sizes) - 1:
            yield [c[first : at + 1] for c in columns]
            first, total = at + 1, 0


def vocabulary(documents: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The corpus' words, and rows ``(hash, n)`` with the counts of those that are rarer than one in ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> Iterator[pa.RecordBatch]:
            hashed, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            times = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            for i in range(0, len(hashed), _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(hashed[i : i + _CHUNK]), pa.array(times[i : i + _CHUNK])], names=["hash", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for (some,) in _groups([texts], [len(t or b"") for t in texts]):
                held.append(np.unique(word_hashes(some)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > _HELD:
                yield from emit()
                held = []
        if held:
            yield from emit()

    in_small_batches(documents.sparkSession)
    counted = cut(documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // head))
    heads = counted.filter(F.col("n") >= least).toArrow()  # at most ``head`` words
    hashed, n = (heads.column(c).to_numpy() for c in ("hash", "n"))
    order = np.lexsort((hashed, -n))
    hashed, n = hashed[order], n[order]
    cells = np.minimum((np.cumsum(n) - n / 2) * (CELLS / max(1, total)), CELLS - 1).astype(np.int64)
    words = Vocabulary(first=min(int(n.sum() * (CELLS / max(1, total))), CELLS - 1))
    words.mass = np.bincount(cells, n, CELLS)
    tail = counted.filter(F.col("n") < least)
    of_tail = F.lit(words.first) + F.shiftright(F.shiftright("hash", 32) * (CELLS - words.first), 31)
    for r in tail.groupBy(of_tail.alias("cell")).agg(F.sum("n").alias("n")).collect():  # at most CELLS rows
        words.mass[r["cell"]] += r["n"]
    by_hash = np.argsort(hashed)
    words.heads, words.cells = hashed[by_hash], cells[by_hash].astype(np.uint16)
    words.within = np.log(n[by_hash] / words.mass[cells[by_hash]]).astype(np.float32)
    return words, tail


class Tree:
    """The halvings that lead to each cell in use; one whose other side is empty is none.

    Nodes are numbered from the root, level by level.  The first ``_TOP`` levels have so few that all of them are worked out for
    every window at once; those below are listed for each cell.
    """

    def __init__(self, mass: np.ndarray):
        used = np.flatnonzero(mass)
        self.prior, self.real = np.zeros(1 << LEVELS, np.float32), np.zeros(1 << LEVELS, bool)
        nodes, sides, of = [], [], []
        for level in range(LEVELS):
            here, side = used >> (LEVELS - level), (used >> (LEVELS - 1 - level)) & 1
            both = np.bincount(2 * here + side, mass[used], 2 << level).reshape(-1, 2)
            real = (both > 0).all(1)
            at = (1 << level) - 1 + np.flatnonzero(real)
            self.prior[at], self.real[at] = np.log(both[real, 1] / both[real, 0]), True
            if level >= _TOP:
                kept = real[here]
                nodes.append(((1 << level) - 1 + here)[kept])
                sides.append(2 * side[kept] - 1)
                of.append(used[kept])
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        self.nodes, self.sides = np.concatenate(nodes)[order].astype(np.uint16), np.concatenate(sides)[order].astype(np.float32)
        self.steps = np.bincount(of, minlength=1 << LEVELS)
        self.starts = np.cumsum(self.steps) - self.steps

    def top(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(nodes, sides)`` of the first levels, a row for each target; a side of 0 where there is no halving."""
        levels = np.arange(_TOP)
        nodes = (1 << levels) - 1 + (targets[:, None].astype(np.int64) >> (LEVELS - levels))
        sides = ((targets[:, None] >> (LEVELS - 1 - levels)) & 1).astype(np.float32) * 2 - 1
        return nodes, sides * self.real[nodes]

    def below(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, node, side, steps)``: every further halving on the way to each target, in order of the targets."""
        steps = self.steps[targets]
        row = np.repeat(np.arange(len(targets)), steps)
        at = np.arange(len(row)) + np.repeat(self.starts[targets] - (np.cumsum(steps) - steps), steps)
        return row, self.nodes[at], self.sides[at], steps


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _gathered(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, sum of values of each, how many)`` for 16-bit row numbers ``at``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[starts].astype(np.int64), np.add.reduceat(values.take(order, 0), starts, axis=0), np.diff(starts, append=len(at))


@dataclass
class Network:
    """One matrix: an embedding for each cell and the edge, a vector and bias for each halving, a scale for each offset, a bias."""

    rows: np.ndarray

    @staticmethod
    def start(tree: Tree) -> Network:
        random = np.random.default_rng(0)
        rows = np.zeros(((2 << LEVELS) + len(OFFSETS) + 1, WIDTH + 1), np.float32)
        rows[: 1 << LEVELS, :WIDTH] = random.normal(0, 0.3, (1 << LEVELS, WIDTH))
        rows[1 << LEVELS : 2 << LEVELS, WIDTH] = tree.prior  # at first every halving has its share of the corpus
        rows[2 << LEVELS : -1, :WIDTH] = random.normal(0.5, 0.2, (len(OFFSETS), WIDTH))
        return Network(rows)

    @property
    def embeddings(self) -> np.ndarray:
        return self.rows[: 1 << LEVELS]

    @property
    def halvings(self) -> np.ndarray:
        return self.rows[1 << LEVELS : 2 << LEVELS]

    @property
    def scales(self) -> np.ndarray:
        return self.rows[2 << LEVELS :]

    def hidden(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(embeddings of the runs, hidden values of the words in them)``; the last hidden value is one."""
        held = self.embeddings.take(runs, 0)
        out = sum(held[:, _REACH + o : _REACH + o + _RUN] * s for o, s in zip(OFFSETS, self.scales)) + self.scales[-1]
        np.tanh(out, out=out)
        out[:, :, WIDTH] = 1
        return held, out.reshape(-1, WIDTH + 1)

    def log_p(self, tree: Tree, runs: np.ndarray) -> np.ndarray:
        """The log-probability of the cell of each word in the runs, given those around it."""
        target = runs[:, _REACH : _REACH + _RUN].ravel()
        real = np.flatnonzero(target != EDGE)
        target, hidden = target[real], self.hidden(runs)[1][real]
        nodes, sides = tree.top(target)
        z = np.take_along_axis(hidden @ self.halvings[:_TOP_NODES].T, nodes, 1)
        out = (np.abs(sides) * softplus(-sides * z)).sum(1, dtype=float)
        row, node, side, steps = tree.below(target)
        z = side * np.einsum("ij,ij->i", np.repeat(hidden, steps, 0), self.halvings.take(node, 0))
        return -out - np.bincount(row, softplus(-z), len(target))

    def trained(self, tree: Tree, runs: np.ndarray, rate: float = RATE) -> tuple[Network, np.ndarray]:
        """One pass over the windows of ``runs`` by Adagrad; the network and how often each row was touched."""
        net = Network(self.rows.copy())
        touched, seen = np.zeros(len(self.rows), np.float32), np.full(len(self.rows), 1e-6, np.float32)

        def step(rows, slope: np.ndarray, many) -> None:
            if isinstance(rows, slice):
                rows = np.arange(*rows.indices(len(seen)))
            now = seen.take(rows) + np.einsum("ij,ij->i", slope, slope) / (WIDTH + 1)
            touched[rows] = touched.take(rows) + many
            seen[rows] = now
            net.rows[rows] = net.rows.take(rows, 0) - (rate / np.sqrt(now))[:, None] * slope

        for at in range(0, len(runs), _BATCH_RUNS):
            lines = runs[at : at + _BATCH_RUNS]
            held, every = net.hidden(lines)
            target = lines[:, _REACH : _REACH + _RUN].ravel()
            real = np.flatnonzero(target != EDGE)
            target, hidden, top = target[real], every[real], net.halvings[:_TOP_NODES]
            nodes, sides = tree.top(target)
            z = np.take_along_axis(hidden @ top.T, nodes, 1)
            errors = np.zeros((len(target), _TOP_NODES), np.float32)
            np.put_along_axis(errors, nodes, -sides / (1 + np.exp(np.clip(sides * z, -30, 30))), 1)
            slope = errors @ top
            row, node, side, steps = tree.below(target)
            if len(row):
                halving, here = net.halvings.take(node, 0), np.repeat(hidden, steps, 0)
                error = -side / (1 + np.exp(np.clip(side * np.einsum("ij,ij->i", here, halving), -30, 30)))
                some = np.flatnonzero(steps)
                slope[some] += np.add.reduceat(error[:, None] * halving, (np.cumsum(steps) - steps)[some], axis=0)
            slope *= 1 - hidden * hidden  # the constant one has no slope
            inner = np.zeros_like(every)
            inner[real] = slope
            inner = inner.reshape(len(lines), _RUN, -1)
            to_held, to_scales = np.zeros_like(held), np.empty((len(OFFSETS) + 1, WIDTH + 1), np.float32)
            for i, o in enumerate(OFFSETS):
                place = slice(_REACH + o, _REACH + o + _RUN)
                to_held[:, place] += inner * net.scales[i]
                to_scales[i] = np.einsum("rwd,rwd->d", held[:, place], inner)
            to_scales[-1] = slope.sum(0)
            if len(row):
                rows, of_node, many = _gathered(error[:, None] * here, node)
                step(rows + (1 << LEVELS), of_node, many)
            step(slice(1 << LEVELS, (1 << LEVELS) + _TOP_NODES), errors.T @ hidden, np.bincount(nodes.ravel(), minlength=_TOP_NODES))
            step(*_gathered(to_held.reshape(-1, WIDTH + 1), lines.ravel()))
            step(slice(2 << LEVELS, None), to_scales, len(target))
        return net, touched


def runs_of(codes: np.ndarray) -> np.ndarray:
    """A text's cells in rows of ``_RUN`` words with the words on either side; the edge beyond the text."""
    n = -(-len(codes) // _RUN)
    padded = np.full(n * _RUN + 2 * _REACH, EDGE, np.uint16)
    padded[_REACH : _REACH + len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, _RUN + 2 * _REACH)[::_RUN] if n else np.empty((0, _RUN + 2 * _REACH), np.uint16)


def encode(documents: DataFrame, words: Vocabulary) -> DataFrame:
    """Rows ``(doc_id, n_words, within, tail, cells)``, one for each document.

    ``cells`` are its words' cells, 16 bits each; ``tail`` the hashes of words that are not among the heads; ``within`` the
    log-shares of all words in their cells, but for the counts of the tail.
    """
    in_small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(words)  # at most HEAD words and CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            for ids, texts in _groups(rows, [len(t or b"") for t in rows[1]]):
                hashed, many = word_hashes(texts)
                cells, each, head = shared.value.coded(hashed)
                ends, of = np.cumsum(many), np.repeat(np.arange(len(texts)), many)
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[~head], minlength=len(texts))))), pa.int32()), pa.array(hashed[~head]))
                blobs = [cells[e - m : e].tobytes() for e, m in zip(ends, many)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(many, pa.int64()), pa.array(np.bincount(of, each, len(texts))), tails, pa.array(blobs, pa.binary())], names=["doc_id", "n_words", "within", "tail", "cells"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, within double, tail array<long>, cells binary")


@dataclass
class PseudoLikelihood:
    """``tail`` has rows ``(hash, n)`` for the words that are not among the heads."""

    words: Vocabulary
    network: Network
    tail: DataFrame


def _runs(coded: DataFrame, parts: int) -> DataFrame:
    """Rows ``(part, run)``: runs of cells, dealt over training tasks; every word is in the middle of one window.

    Where a text's runs begin to be dealt follows from its words and its id, so copies of a text go to all parts.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, blobs = [], []
        for key, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = np.ascontiguousarray(runs_of(np.frombuffer(cells, np.uint16)))
            part.append(((key + np.arange(len(lines))) % parts).astype(np.int32))
            blobs += map(bytes, lines)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(blobs, pa.binary())], names=["part", "run"])

    return map_batches(coded.select(F.pmod(F.xxhash64("cells", "doc_id"), F.lit(1 << 40)).alias("key"), "cells"), run, "part int, run binary")


_COPY = "part int, piece int, rows binary, weights binary"


def _copies(part: int, rows: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece, (r, w) in enumerate(zip(np.array_split(rows, _PIECES), np.array_split(weights, _PIECES))):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([r.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["part", "piece", "rows", "weights"])


def _averaged(copies: DataFrame) -> DataFrame:
    """One copy for every ``_MEET`` of them: each row's mean, weighted by how often the copies touched it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                w = np.frombuffer(r["weights"], np.float32)
                rows = np.frombuffer(r["rows"], np.float32).reshape(len(w), -1)
                total = sums.setdefault((r["part"], r["piece"]), [np.zeros(rows.shape), np.zeros(len(w)), rows])
                total[0] += rows * w[:, None]
                total[1] += w
        for (part, piece), (total, w, own) in sums.items():
            mean = np.where(w[:, None] > 0, total / np.maximum(w, 1e-30)[:, None], own).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["part", "piece", "rows", "weights"])

    grouped = copies.withColumn("of", F.col("part")).withColumn("part", F.floor(F.col("part") / _MEET).cast("int"))
    return grouped.repartition("part", "piece").sortWithinPartitions("part", "piece", "of").drop("of").mapInArrow(run, _COPY)


def fit(coded: DataFrame, words: Vocabulary, rounds: int = ROUNDS, task_windows: int = TASK_WINDOWS) -> Network:
    """Train on all windows of the coded documents; without words the network stays as it starts."""
    spark = coded.sparkSession
    network = Network.start(Tree(words.mass))
    total = int(words.mass.sum())
    if not total:
        return network
    parts = -(-total // task_windows)
    runs = _runs(coded, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "run")
    runs = cut(runs) if rounds > 1 else runs
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((network, words.mass))

        def trained(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            def of(part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
                lines = np.frombuffer(b"".join(blobs), np.uint16).reshape(len(blobs), -1)
                lines = lines[np.random.default_rng((part, turn)).permutation(len(lines))]
                net, touched = start.trained(tree, lines)
                yield from _copies(part, net.rows, touched)

            start, tree = now.value[0], Tree(now.value[1])
            at, blobs = None, []
            for batch in batches:
                for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if part != at and blobs:
                        yield from of(at, blobs)
                        blobs = []
                    at = part
                    blobs.append(blob)  # about task_windows words in all
            if blobs:
                yield from of(at, blobs)

        copies, many = cut(runs.mapInArrow(trained, _COPY)), parts
        while many > 1:
            copies, many = _averaged(copies), -(-many // _MEET)
        pieces = {r["piece"]: np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH + 1) for r in copies.collect()}  # one network
        network = Network(np.concatenate([pieces[p] for p in range(_PIECES)]))
    return network


def _score(coded: DataFrame, model: PseudoLikelihood) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((model.network, model.words.mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tree = shared.value[0], Tree(shared.value[1])
        for batch in batches:
            cells = [np.frombuffer(c, np.uint16) for c in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            lines = np.concatenate([runs_of(c) for c in cells])
            sums, at = np.zeros(len(cells)), 0
            for i in range(0, len(lines), _SCORE_RUNS):
                found = network.log_p(tree, lines[i : i + _SCORE_RUNS])
                sums += np.bincount(of[at : at + len(found)], found, len(cells))
                at += len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + sums)], names=["row", "known"])

    rows = coded.withColumn("row", F.monotonically_increasing_id())
    known = rows.select("row", "within", "cells").mapInArrow(run, "row long, known double")
    rare = rows.select("row", F.explode("tail").alias("hash")).join(model.tail, "hash", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log(F.coalesce(F.col("n").cast("double"), F.lit(_UNSEEN)))).alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    joined = rows.select("row", "doc_id", "n_words").join(known, "row").join(rare, "row", "left")
    return joined.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))


def train(documents: DataFrame, rounds: int = ROUNDS, task_windows: int = TASK_WINDOWS, head: int = HEAD) -> PseudoLikelihood:
    """Fit on the whole corpus; an empty one gives a model that has seen no word."""
    words, tail = vocabulary(documents, head)
    return PseudoLikelihood(words, fit(cut(encode(documents, words)), words, rounds, task_windows), tail)


def score(documents: DataFrame, model: PseudoLikelihood) -> DataFrame:
    """Rows ``(doc_id, n_words, log_likelihood, mean_log_likelihood)``, one for each document.

    Null and wordless texts have no words, a sum of 0 and a null mean; repeated rows get equal scores (up to rounding); an empty
    table gives no rows; a word that the corpus has not counts half; other columns are ignored.
    """
    return _score(cut(encode(documents, model.words)), model)


def train_and_score(documents: DataFrame, rounds: int = ROUNDS, task_windows: int = TASK_WINDOWS, head: int = HEAD) -> DataFrame:
    """``score(documents, train(documents))``, with the words looked up once."""
    words, tail = vocabulary(documents, head)
    coded = cut(encode(documents, words))
    return _score(coded, PseudoLikelihood(words, fit(coded, words, rounds, task_windows), tail))
