"""Runs and repeated substrings, held against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumicell.llm import runs, substrings
from lumicell.llm.words import Stretches, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = SCHEMA + ", runs int, collapsed string, `a.b` long, words string, c0 int, start long, doc_key long, first string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, words=4):
    return [rng.choice("abcdefghijklmnop"[:words]) for _ in range(n)]


def awkward(spark, rows, clashing=False):
    rows = rows + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \t\r\n\x0b\x0c ", "en", "s", 1), (9003, "one", None, "s", 1), (None, "no id here", "en", "s", 1), (None, None, None, None, None), rows[0], rows[0]]
    rows += [(9004, "a b\x1cc  d\u0085 e  f\x00g", "en", "s", 2), (9005, "x" * 400_000 + " y", "en", "s", 2)]
    return spark.createDataFrame([r + ((7, "k", 5, "w", 2, 3, 4, "f") if clashing else ()) for r in rows], CLASHING if clashing else SCHEMA)


# Words


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", " lead  and\ttrail \n", "é ü x", "x" * 600_000 + " tail", "a b", "\x1c\x85", "one"]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for c in (column, pa.concat_arrays([pa.array([b"zz"]), column]).slice(1)):
        found = Words(c)
        assert found.counts().tolist() == [len(split(t)) for t in texts]
        codes, all_words = found.hashes().tolist(), [w for t in texts for w in split(t)]
        assert len(set(codes)) == len(set(all_words)) == len(set(zip(codes, all_words)))
        assert [found.kept(i) for i in range(len(texts))] == [" ".join(split(t)).encode() for t in texts]
        first = np.arange(len(split(texts[2]))) % 2 == 0
        assert found.kept(2, first) == " ".join(w for w, k in zip(split(texts[2]), first) if k).encode()
    assert Words(pa.array([], pa.binary())).hashes().tolist() == []


def test_stretches_are_equal_where_words_are():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    of = Stretches(words)
    spans = [(i, j) for i in range(9) for j in range(i, 10)]
    found = of.hashes(np.array([s[0] for s in spans]), np.array([s[1] for s in spans])).tolist()
    assert all((x == y) == (words[a:b].tolist() == words[c:d].tolist()) for (a, b), x in zip(spans, found) for (c, d), y in zip(spans, found))


# Runs


def plain_runs(words, least=24, exponent=3):
    out, n = [], len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(least, exponent * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_texts(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(0, 60), rng.randint(1, 3)) for _ in range(40)]
    for _ in range(25):  # periods with a few other words
        unit = prose(rng, rng.randint(1, 25), 6)
        text = prose(rng, rng.randint(0, 10), 6) + unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))] + prose(rng, rng.randint(0, 30), 3)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = "odd"
        texts.append(text)
    inner = ["x"] * 30 + ["y"]
    texts += [inner * 4, ["z"] * 200, (["a"] * 9 + ["b"]) * 12 + ["a"] * 30, ["p", "q"] * 40 + ["r"] + ["p", "q"] * 40]
    return texts


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (10, 4), (1, 2)])
def test_runs_equal_brute_force(least, exponent):
    for seed in range(4):
        texts = repeated_texts(seed)
        column = Words(pa.array([" ".join(t).encode() for t in texts], pa.binary()))
        found = runs.runs_of(column.hashes(), column.text_of(), least, exponent)
        assert found == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, exponent)]


def test_long_repeats_take_little_time():
    rng = random.Random(1)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    line = [f"v{i}" for i in range(30)]
    cases = [["same"] * 150_000, unit * 5, [w for i in range(5_000) for w in (f"k{i}", *line)], (["a"] * 50 + ["b"]) * 4_000]
    for words in cases:
        began = time.time()
        column = Words(pa.array([" ".join(words).encode()], pa.binary()))
        found = runs.runs_of(column.hashes(), column.text_of())
        assert time.time() - began < 40
        assert len(found) == {0: 1, 1: 1, 2: 0, 3: 4_001}[cases.index(words)]


def plain_row(doc_id, text):
    words = split(text)
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    keep = [True] * n
    for s, length, q in found:
        keep[s + q : s + length] = [False] * (length - q)
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_periodic_runs_query(spark):
    rows = [(i, " \n".join(t), "en", "s", 1) for i, t in enumerate(repeated_texts(9) + [prose(random.Random(i), 150, 16) for i in range(60)])]
    docs = awkward(spark, rows, True).repartition(3)
    found = runs.digest(runs.find(runs.periodic(docs))).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sum(r["n_runs"] > 0 for r in found) > 30


def test_find_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c " * 9, "en", "s", 1)]
    found = runs.find(awkward(spark, rows, True))
    assert found.columns == [*awkward(spark, rows, True).columns, "runs_", "collapsed_"] and found.count() == 11
    one = found.filter("doc_id = 1").first()
    assert one["collapsed_"] == "a b c" and [tuple(r) for r in one["runs_"]] == [(0, 27, 3)] and one["a.b"] == 5 and one["runs"] == 7
    assert found.filter("doc_id = 9000").first()["collapsed_"] == "" and found.filter("doc_id = 9000").first()["runs_"] == []
    assert runs.find(spark.createDataFrame([], SCHEMA)).filter(F.size("runs") > 0).count() == 0


# Repeated substrings


def plain_removed(rows, least=20):
    """``{(id, text): (words, removed positions)}``, windows compared as tuples, documents in order."""
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  # Spark's hash is a signed long
    order = sorted({(r["doc_id"], r["text"]) for r in rows}, key=lambda k: (k[0] is None, k[0] or 0, signed(k[1])))
    seen, out = set(), {}
    for key in order:
        words, gone = split(key[1]), set()
        for i in range(len(words) - least + 1):
            window = tuple(words[i : i + least])
            if window in seen:
                gone |= set(range(i, i + least))
            seen.add(window)
        out[key] = (words, gone)
    return out


def repeated_documents(seed, n=60):
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([19, 20, 21, 25, 40, 90]), 16) for _ in range(8)] + [["x"] * 25, ["a", "b"] * 14]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else prose(rng, rng.randint(1, 40), 16)
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = f"odd{rng.randrange(9)}"
            text += part[rng.choice([0, 0, 0, 1, 5]) :]
        texts.append(text)
    return [(rng.choice([i, i, i, -i]), "  ".join(t), "en", "s", 1) for i, t in enumerate(texts + texts[:6])]


@pytest.mark.parametrize("seed,gram", [(1, 8), (2, 8), (3, 20), (4, 1)])
def test_repeats_equal_brute_force(spark, seed, gram):
    rows = repeated_documents(seed)
    long = prose(random.Random(seed), 20_000, 16)
    rows += [(5000, " ".join(long), "en", "s", 1), (4999, " ".join(long[7_000:9_000]), "en", "s", 1), (-3, " ".join(long[100:150]), "en", "s", 1), (rows[10][0], " ".join(long[50:120]), "en", "s", 1)]
    docs = awkward(spark, rows, True).repartition(5)
    want = plain_removed(docs.collect())
    found = substrings.remove(docs, gram=gram)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "repeats", "kept"]
    rows = found.collect()
    assert len(rows) == docs.count() and sum(r["n_removed"] for r in rows) > 2_000
    for r in rows:
        words, gone = want[r["doc_id"], r["text"]]
        assert (r["n_words"], r["n_removed"], r["kept"], r["a.b"]) == (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone), 5)
        spans = [(s["start"], s["end"]) for s in r["repeats"]]
        assert {i for a, b in spans for i in range(a, b)} == gone and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    texts = [prose(rng, 60, 3) for _ in range(80)]
    column = Words(pa.array([" ".join(t).encode() for t in texts], pa.binary()))
    found = substrings.anchors_of(column.hashes(), column.text_of(), 20, 8)
    of = {}
    for t, s, n, a in zip(*(found[c].tolist() for c in ("text", "start", "windows", "anchor"))):
        for i in range(s - int(column.first[t]), s - int(column.first[t]) + n):
            assert of.setdefault(tuple(texts[t][i : i + 20]), a) == a
    assert sum(found["windows"]) == 80 * 41


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, "", None, None, None)], [(1, "short text", "en", "s", 1)] * 2])
def test_nothing_to_remove(spark, rows):
    found = substrings.remove(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(r["n_removed"] == 0 and r["kept"] == (r["text"] or "") for r in found)
