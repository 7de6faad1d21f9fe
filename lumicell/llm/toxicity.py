"""Toxicity classifier with counterfactual regularisation.

A logistic model over word and word-beginning features learns from labelled documents.  Where a labelled
sentence names a group of people, the name is swapped for another group's and the model pays for any
change of score, so weight does not settle on neutral mentions.

The model is fitted in numpy on a sample of at most about ``MOST_TEXTS`` distinct labelled texts, drawn by a hash of
the text; copies of a text, and repeated rows, count once.  Feature statistics are counted in tasks over all of that
sample, and every feature that passes ``LEAST_G`` is used.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import any_names, cut, in_small_batches, map_batches

THRESHOLD = 0.7
MOST_TEXTS = 16_000
#: A feature counts only if texts that have it are toxic more often, by a G statistic of this much (chance: about 1e-4).
LEAST_G = 15
PENALTY, DECAY, STEPS = 1.0, 2e-4, 250
#: Names of groups that are swapped for one another, one list for each kind of group and language.
IDENTITY_TERMS = (
    # English
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "arabes", "asiatiques", "autochtones"),
    ("gays", "hétéros", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("handicapés", "sourds", "aveugles", "vieux", "jeunes"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "heteros", "lesben", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("behinderte", "gehörlose", "blinde", "alte", "junge"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "indígenas"),
    ("gais", "heterosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("discapacitados", "sordos", "ciegos", "ancianos", "jóvenes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 400_000


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return ["=" + word, *("^" + word[:n] for n in range(3, 7) if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(found: set[str], groups=IDENTITY_TERMS) -> set[str] | None:
    """The words with every group name replaced by the next one of its list (of the first list that has it); None if there is none."""
    following: dict[str, str] = {}
    for terms in groups:
        for a, b in zip(terms, terms[1:] + terms[:1]):
            following.setdefault(a, b)
    return {following.get(w, w) for w in found} if found & following.keys() else None


@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def rows(self, found: set[str], cache: dict[str, tuple[int, ...]]) -> set[int]:
        hits: set[int] = set()
        for word in found:
            own = cache.get(word)
            if own is None:
                if len(cache) > _CACHE:
                    cache.clear()
                own = cache[word] = tuple(i for f in word_features(word) if (i := self.index.get(f)) is not None)
            if own:
                hits.update(own)
        return hits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        cache = self.__dict__.setdefault("_cache", {})
        z = np.array([self.bias + sum(self.weights[i] for i in sorted(self.rows(words(t), cache))) for t in texts], float)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}


def fit_logistic(rows: list[list[int]], changed: list[list[int] | None], toxic: np.ndarray, n: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a class-balanced logistic model.

    ``changed`` has the features of each row after swapping group names, or None; the mean square of
    ``score(row) - score(changed row)``, before the sigmoid, is added ``penalty`` times.
    """
    flat = np.array([i for r in rows for i in r], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = [(a, b) for a, b in zip(rows, changed) if b is not None]
    moved = np.array([i for a, b in pairs for i in [*(set(a) - set(b)), *(set(b) - set(a))]], np.int64)
    sign = np.array([s for a, b in pairs for s in [1] * len(set(a) - set(b)) + [-1] * len(set(b) - set(a))], float)
    pair = np.repeat(np.arange(len(pairs)), [len(set(a) ^ set(b)) for a, b in pairs])
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(of, w[flat], len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        slope = np.bincount(flat, error[of], n) + DECAY * w
        if len(pairs):
            gap = np.bincount(pair, sign * w[moved], len(pairs))
            slope = slope + 2 * penalty / len(pairs) * np.bincount(moved, sign * gap[pair], n)
        full = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - change[:-1], bias - change[-1]
    return w, float(bias)


def association(toxic, clean, all_toxic: int, all_clean: int) -> F.Column:
    """G statistic of a feature's presence against the label."""
    n = all_toxic + all_clean
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = (toxic + clean) / n
    absent = F.greatest(1 - share, F.lit(1e-12))
    return 2 * (
        term(toxic, all_toxic * share) + term(clean, all_clean * share)
        + term(all_toxic - toxic, all_toxic * absent) + term(all_clean - clean, all_clean * absent)
    )


def held_out(doc_id) -> F.Column:
    """Whether the CRC32 of the id, as text, leaves 1 when divided by three; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, penalty: float = PENALTY, groups=IDENTITY_TERMS, most_texts: int = MOST_TEXTS) -> Model:
    """Fit on labelled documents that are not held out.  Without labelled rows every score is 0; with one class only, 0 or 1."""
    in_small_batches(documents.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("marked"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    keys = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"))
    texts = keys.join(marks, keys.id == marks.marked).filter(~held_out(F.col("id"))).groupBy("text_key", "toxic").agg(F.min("id").alias("id"))
    texts = cut(texts)
    share = min(1.0, most_texts / max(1, texts.count()))
    chosen = F.broadcast(texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(1 << 20)) < int(share * (1 << 20))).select("id", "text_key", "toxic"))  # most_texts rows
    sample = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    sample = cut(sample.join(chosen, ["id", "text_key"]).dropDuplicates(["id", "text_key", "toxic"]).select("id", "toxic", "text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = defaultdict(lambda: [0, 0])
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in {f for w in words(text) for f in word_features(w)}:
                n[f][toxic] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["feature", "clean", "toxic"])

    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(bias=np.inf if 1 in total else -np.inf)
    seen = map_batches(sample.select("text", "toxic"), count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = seen.withColumn("g", association(F.col("toxic"), F.col("clean"), total[1], total[0]))
    best = best.filter(f"g >= {LEAST_G} and toxic * {total[0]} > clean * {total[1]}").orderBy(F.desc("g"), "feature")
    model = Model({r["feature"]: i for i, r in enumerate(best.select("feature").collect())})  # features that are frequent in most_texts rows

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache: dict = {}
        found = [words(t) for t in batch.column(2).to_pylist()]
        other = [swapped(ws, groups) for ws in found]
        rows = [sorted(model.rows(ws, cache)) for ws in found]
        changed = [None if ws is None else sorted(model.rows(ws, cache)) for ws in other]
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind), pa.array(changed, kind)], names=["id", "toxic", "rows", "changed"])

    fitted = map_batches(sample.select("id", "toxic", "text"), present, "id long, toxic int, rows array<int>, changed array<int>").toPandas()  # most_texts rows
    fitted = fitted.sort_values(["id", "toxic"])
    model.weights, model.bias = fit_logistic([list(r) for r in fitted["rows"]], [None if c is None else list(c) for c in fitted["changed"]], fitted["toxic"].to_numpy(), len(model.index), penalty)
    return model


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one for each document.

    Whole texts are scored; a null or wordless text gets the model's base score, repeated rows equal
    scores, an empty table no rows.  Only the text enters a score; other columns are ignored.
    """
    in_small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # features of MOST_TEXTS rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_batches(narrow, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@any_names
def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, all their columns as they are; nothing is shuffled."""
    in_small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < threshold))

    return map_batches(documents, run, documents.schema)
