"""Operators on vectors, pages and conversations, and the pipeline, against brute force."""

import gzip
import hashlib
import io
import json
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lumicell.llm import decontam, mixing, nsbounds, permindex, queries, sharding, simhash, toolcalls, toxicity, warc
from lumicell.llm.shared import read_table

# Nearest neighbours


def plain_nearest(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    first = {}
    for i, v in sorted(good, key=lambda r: (r[0], len(r[1]), r[1].tolist())):
        first.setdefault((i, len(v)), v)
    out = {}
    for (q, n), v in first.items():
        if q % every == 0:
            unit = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max())[1])
            v = unit(v)
            near = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in ((i, unit(w)) for i, w in good if i != q and len(w) == n))[:k]
            out |= {(q, rank + 1, i): -s for rank, (s, i) in enumerate(near)}
    return out


def vector_rows(n=400):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # a common vector
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [1.0] * 3), (None, [1.0] * 8), (1050, [float("inf")] * 8), (1100, [1e-30] * 8), rows[0]]
    rows += [(1150, [1.0, 2.0, 3.0]), (1151, []), (1200, [1e-170, -2e-170] * 4), (1201, [1e200, -2e200] * 4), (1250, [1e-320] * 8), (1251, [1e308] * 8)]
    return rows


def test_nearest_with_everything_reranked_is_exact(spark):
    rows = vector_rows()
    table = spark.createDataFrame([r + (1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    found = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in permindex.nearest(table, recall=1.0).collect()}
    want = plain_nearest(rows)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]) for r in permindex.nearest(table).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, 3000, 50):
        near = x @ x[q]
        near[q] = -9
        hits += [(q, int(i)) in found for i in np.argsort(-near)[:5]]
    assert np.mean(hits) >= 0.9 and len(found) == 300


def test_footrule():
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(20)[:6] for _ in range(30)])
    posted = permindex.Postings(orders, 20)
    place = lambda o: np.array([list(o).index(p) if p in o else 6 for p in range(20)])
    want = [int(np.abs(place(o) - place(orders[0])).sum()) for o in orders]
    assert posted.footrule(orders[0]).tolist() == want


# Ns-bounds


def plain_clusters(rows, k, rounds, width):
    """Every distance in every round, in Python's integers."""
    kept = [(i, [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and None not in v and all(map(math.isfinite, v))]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for t in range(rounds + 1):
        own = [min((square(q, c), n) for n, c in enumerate(centroids)) for _, q in kept]
        if t < rounds:
            for n in range(len(centroids)):
                members = [q for (_, q), (_, c) in zip(kept, own) if c == n]
                centroids[n] = [sum(x) // len(members) for x in zip(*members)] if members else centroids[n]
    inertia, fits = Counter(), lambda v: v if v < 1 << 63 else None
    for d, c in own:
        inertia[c] += d
    big = {c for d, c in own if d >= 1 << 63}
    total = None if big else sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, fits(d), None if c in big else fits(inertia[c]), total, digest[c]) for (i, _), (d, c) in zip(kept, own)]


def cluster_rows(width, wide):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=width) + i % 7).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(80)] + [rows[9], rows[9], (None, rows[3][1]), (None, [0.5] * width), (500, [0.0] * width), (501, [-0.001] * width)]
    rows += [(600, None), (601, []), (602, [1.0] * (width - 1)), (603, [None] + [1.0] * (width - 1)), (604, [float("nan")] * width), (605, [float("-inf")] * width)]
    if wide:
        rows += [(700 + i, (rng.normal(size=width) * 10.0 ** (5 + i % 4)).tolist()) for i in range(20)]
    return rows + ([(800, [1e30] * width), (801, [-1e300] + [0.0] * (width - 1))] if wide == 2 else [])


@pytest.mark.parametrize("wide", [0, 1, 2])
def test_clusters_equal_brute_force(spark, wide):
    rows = cluster_rows(8, wide)
    table = spark.createDataFrame([r + (1, 2, "s") for r in rows], "vec_id long, embedding array<double>, cluster int, x long, own string").repartition(3)
    work = []
    found = nsbounds.cluster(table, 12, 5, 8, work=work).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_clusters(rows, 12, 5, 8), key=repr)
    assert work[0] == 12 * len(found) and all(w < work[0] for w in work[2:])  # bounds save distances


def test_bounds_hold_through_all_rounds():
    """Bounds from the centroid's total displacement never lose the nearest centroid, ties included."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-6, 7, (500, 3)).astype(float)  # small grids have many ties
    history, known = [[[int(v) for v in vectors[i]] for i in range(9)]], (None, None, None)
    for t in range(8):
        centroids = nsbounds.Centroids(history)
        cluster, distance, seen, own, _ = nsbounds.assign(vectors, *known, centroids)
        squares = ((vectors[:, None] - np.array(history[-1])) ** 2).sum(2)
        assert (cluster == squares.argmin(1)).all() and all(o in (-1, s) for o, s in zip(own, squares.min(1)))
        known = (cluster, distance, seen.astype(np.int64))
        history.append([[int(x) for x in np.array(c) + rng.integers(-2, 3, 3)] for c in history[-1]])


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nsbounds.cluster(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (None, [2.0] * 64)]
    assert sorted(map(tuple, nsbounds.cluster(spark.createDataFrame(rows, schema)).collect()), key=repr) == sorted(plain_clusters(rows, 40, 5, 64), key=repr)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])]])
def test_few_vectors(spark, rows):
    found = permindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(found) == sum(i % 50 == 0 for i, _ in rows) * max(0, len(rows) - 1)


# WARC


def page_rows():
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh <>/é") for _ in range(3000))
    rows = [(i, f"http://x/{i}?q=a b\n", "<p>" + long[i * 10 : i * 10 + rng.randint(0, 900)]) for i in range(80)]
    rows += [(100 + i, "http://copy/", long) for i in range(40)] + [(200 + i, None, "short") for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", long), (None, None, None), rows[5], rows[90], (400, "u", "\x1f�\x08" * 200), (401, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (402, "u", long * 200)]
    return rows


def plain_archive(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    first = defaultdict(list)
    for i, p in payload:
        if len(p) >= 100 and i is not None:
            first[p].append(i)
    out = []
    for i, p in payload:
        least = min(first[p]) if len(p) >= 100 and first[p] else None
        again = least is not None and i != least
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least if again else None))
    return Counter(out)


@pytest.mark.parametrize("split", [97, 4000, 8 << 20])
def test_round_trip(spark, split):
    rows = page_rows()
    table = spark.createDataFrame([r + (1, "x") for r in rows], "page_id long, url string, html string, payload_bytes long, salt string").repartition(3)
    assert Counter(map(tuple, warc.round_trip(table, split).collect())) == plain_archive(rows)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_members_are_found_in_ranges_and_false_magic_is_not():
    records = [warc.record(i, "u", bytes(random.Random(i).randbytes(500)) + b"\x1f\x8b\x08" * 5, 515, hashlib.sha256(bytes(random.Random(i).randbytes(500)) + b"\x1f\x8b\x08" * 5).hexdigest(), None) for i in range(20)]
    data = b"\x1f\x8b\x08 not a member".join([gzip.compress(b"no record"), *records, b""])
    for step in (1, 50, 333, 5000):
        got = [warc.parse(r)[1] for low in range(0, len(data), step) for r in warc.owned_records(io.BytesIO(data), len(data), low, min(len(data), low + step))]
        assert got == list(range(20))
    cut = data[: len(data) - 40]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.owned_records(io.BytesIO(cut), len(cut), 0, len(cut)))


def test_archives_from_elsewhere(spark, tmp_path):
    """No manifest, header names in lower case, digests of another kind, and records without this library's own fields."""
    def member(kind, uri, body):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        head = f"WARC/1.0\r\nwarc-type:{kind}\r\nwarc-target-uri: {uri}\r\nWARC-PAYLOAD-DIGEST: sha1:ABC\r\ncontent-length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    (tmp_path / "b").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(member("warcinfo", "info", b"x") + member("response", "http://a/", b"<p>one"))
    (tmp_path / "b/c.warc.gz").write_bytes(member("response", "http://c/", b"<p>two" * 500))
    (tmp_path / "note.txt").write_text("not an archive")
    found = {(r["record_type"], r["target_uri"], bytes(r["payload"] or b"")) for r in warc.read_archives(spark, f"file://{tmp_path}", 50).collect()}
    assert found == {("warcinfo", "info", b""), ("response", "http://a/", b"<p>one"), ("response", "http://c/", b"<p>two" * 500)}
    assert warc.read_archives(spark, f"file://{tmp_path}/a.warc.gz").count() == 2


def test_revisits_refer_to_their_record():
    ids = {}
    for page, refers in ((7, None), (9, 7)):
        text = gzip.decompress(warc.record(page, f"u{page}", None if refers else b"body" * 50, 200, "d", refers)).decode()
        ids[page] = dict(line.split(": ", 1) for line in text.split("\r\n\r\n")[0].split("\r\n")[1:])
    assert ids[9]["WARC-Refers-To"] == ids[7]["WARC-Record-ID"] != ids[9]["WARC-Record-ID"] and "WARC-Refers-To" not in ids[7]


# Tool calls

SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}}, "additionalProperties": False}}


@pytest.mark.parametrize(
    "name,arguments,found",
    [
        ("f", '{"a":1,"b":"x"}', []), ("f", '{"b":"z","c":1}', ["$.a: missing", "$.b: not among the allowed values", "$.c: not allowed"]), ("f", '{"a":true}', ["$.a: not of type integer"]),
        ("f", '{"a":-1}', ["$.a: below the minimum"]), ("f", "[", ["$: not JSON"]), ("f", None, ["$: not JSON"]), ("g", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]), ("f", "[1]", ["$: not of type object"]),
        ("f", '{"a":1.0}', []), ("f", '{"a":1.5}', ["$.a: not of type integer"]), ("f", '{"a":1e400}', ["$: not JSON"]), ("f", '{"a":NaN}', ["$: not JSON"]), ("f", '{"a":-Infinity}', ["$: not JSON"]),
        ("f", "[" * 100_000, ["$: not JSON"]), ("f", "[" * 100_000 + "]" * 100_000, ["$: not JSON"]), ("f", '{"a":' + "9" * 5000 + "}", ["$: not JSON"]), ("f", '{"\\ud800":1}', ["$.a: missing", "$.\ufffd: not allowed"]),
        ("h", '"text"', []), ("h", "5", ["$: below the minimum"]), ("h", "null", []), ("h", "true", ["$: not of type number or string or null"]), ("h", '"' + "[" * 500 + '"', []),
    ],
)
def test_check_call(name, arguments, found):
    schemas = SCHEMAS | {"h": {"type": ["number", "string", "null"], "minimum": 6, "minLength": 2}}
    got = toolcalls.check_call(name, arguments, schemas)
    assert got[0] == found
    assert json.loads(toolcalls.canonical(got[1])) == got[1]
    toolcalls.canonical(got[1]).encode()


def test_canonical():
    assert toolcalls.canonical({"b": [1.0, 2.5, None], "a": {"é": True, "c": "x\n"}}) == '{"a":{"c":"x\\n","é":true},"b":[1,2.5,null]}'
    assert toolcalls.canonical("\ud800x") == '"\\ud800x"' and toolcalls.canonical(1e300) == "1e+300"
    with pytest.raises(ValueError):
        toolcalls.canonical(float("nan"))
    with pytest.raises(ValueError, match="unknown types"):
        toolcalls.problems(1, {"type": "text"})


def plain_depths(needs):
    """``{call: depth}`` by walking; a call on or above a cycle has none."""
    found, open_ = {}, set()

    def depth(c):
        if c in open_:
            return None
        if c not in found:
            open_.add(c)
            below = [depth(n) for n in sorted(needs[c]) if n in needs]
            open_.discard(c)
            found[c] = None if None in below else max((b + 1 for b in below), default=0)
        return found[c]

    cyclic = {c for c in needs if any(c in reach(needs, n) for n in needs[c] if n in needs)}
    bad = {c for c in needs if reach(needs, c) & cyclic}
    clean = {c: n for c, n in needs.items() if c not in bad}
    needs = clean
    return {c: depth(c) for c in clean} | dict.fromkeys(bad)


def reach(needs, start):
    seen, left = set(), [start]
    while left:
        c = left.pop()
        if c not in seen and c in needs:
            seen.add(c)
            left += needs[c]
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_depths_of_chains_forks_and_cycles(spark, seed):
    rng = random.Random(seed)
    needs = {f"c{i}": {f"c{i - rng.randint(1, 3)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))} for i in range(60)}
    needs |= {f"l{i}": {f"l{i - 1}"} for i in range(1, 40)} | {"l0": {"c59"}, "x": {"y"}, "y": {"z"}, "z": {"x"}, "w": {"x", "c1"}, "v": {"w"}, "u": {"u"}, "t": {"nowhere"}}
    rows = [(1, c, sorted(n)) for c, n in needs.items()] + [(2, "x", ["y"]), (2, "y", None)]
    found = toolcalls.depths(spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>")).collect()
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in found}
    assert got == {(1, c): d for c, d in plain_depths(needs).items()} | {(2, "x"): 1, (2, "y"): 0}


def test_link(spark):
    calls = [
        (1, "a", 1, "f", '{"a": 1}', ["b", "zzz"]), (1, "b", 3, "f", '{"a": 2}', None), (1, "c", 5, "f", '{"a": 3}', ["a"]), (1, "a", 7, "f", '{"a": 4}', []),
        (2, "a", 1, "g", "{", ["c"]), (2, "b", 2, "f", '{"a": 1}', ["a"]), (2, "c", 3, "f", '{"a": 1}', ["b"]), (2, "d", 4, "f", '{"a": 1}', ["c"]), (2, "e", 5, "f", None, []),
        (None, "a", 1, "f", '{"a": 1}', []), (3, None, 1, None, None, ["a"]), (1, "b", 3, "f", '{"a": 2}', None),
    ]
    results = [(1, "a", 2, "ra"), (1, "a", 9, "later"), (1, "b", 2, "early"), (2, "d", 9, None), (4, "x", 1, "lost"), (None, "a", 2, "r"), (3, None, 2, "r"), (1, "c", 6, "rc")]
    c = spark.createDataFrame([r + ("x",) for r in calls], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, position string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    rows = toolcalls.link(c, r, SCHEMAS).collect()
    got = {(x["conv_id"], x["call_id"], x["turn"], x["status"]): x for x in rows}
    status = Counter((x["conv_id"], x["call_id"], x["status"]) for x in rows)
    assert status == Counter({
        (1, "a", "linked"): 1, (1, "a", "duplicate"): 1, (1, "b", "early"): 2, (1, "c", "linked"): 1, (2, "a", "cycle"): 1, (2, "b", "cycle"): 1, (2, "c", "cycle"): 1, (2, "d", "cycle"): 1,
        (2, "e", "pending"): 1, (None, "a", "pending"): 1, (3, None, "pending"): 1, (4, "x", "orphan"): 1, (None, "a", "orphan"): 1, (3, None, "orphan"): 1,
    })
    assert [got[k]["depth"] for k in ((1, "b", 3, "early"), (1, "a", 1, "linked"), (1, "c", 5, "linked"))] == [0, 1, 2]
    assert json.loads(got[1, "a", 1, "linked"]["canonical"]) == {"arguments": {"a": 1}, "id": "a", "name": "f", "needs": ["b", "zzz"], "result": "ra"}
    assert got[1, "a", 1, "linked"]["problems"] == ["2 results"] and got[1, "c", 5, "linked"]["valid"]
    assert {x["position"] for x in rows if x["conv_id"] is None} == {None}
    assert json.loads(got[2, "a", 1, "cycle"]["canonical"]) == {"arguments": None, "id": "a", "name": "g", "needs": ["c"], "raw": "{"}
    for conv in (1, 2, 3, 4):
        own = sorted((x["position"], x["depth"] if x["depth"] is not None else 99, x["turn"]) for x in rows if x["conv_id"] == conv)
        assert [p for p, *_ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: (x[1], x[2]))
    assert toolcalls.link(c.limit(0), r.limit(0), SCHEMAS).count() == 0
    assert {x["status"] for x in toolcalls.link(c.limit(0), r, SCHEMAS).collect()} == {"orphan"}


def test_conversations_are_linked_and_ordered(spark, small):
    found = queries.op1_tool_calls(spark, small).collect()
    calls, results = toolcalls.calls_of_conversations(read_table(spark, small, "conversations"))
    want = {(c["conv_id"], c["call_id"]): c for c in calls.collect()}
    answers = {(a["conv_id"], a["call_id"]) for a in results.collect()}
    assert len(found) == len(want) + len(answers - want.keys())
    depth = {}

    def level(key):
        if key not in depth:
            depth[key] = max((level((key[0], n)) + 1 for n in want[key]["needs"] if (key[0], n) in want), default=0)
        return depth[key]

    for r in found:
        key = r["conv_id"], r["call_id"]
        assert r["status"] == ("orphan" if key not in want else "linked" if key in answers else "pending")
        if key in want:
            assert r["depth"] == level(key)
    place = {(r["conv_id"], r["call_id"]): r["position"] for r in found}
    assert all(place[k] > place[k[0], n] for k, c in want.items() for n in c["needs"] if (k[0], n) in want)


def test_a_conversation_of_many_cells(spark):
    n = 1500
    calls = spark.range(n).selectExpr("1L as conv_id", "string(id) as call_id", "id as turn", "'f' as name", "'{\"a\":1}' as arguments", "case when id % 3 <> 0 then array(string(id - 1)) else array() end as needs")
    results = spark.range(n).selectExpr("1L as conv_id", "string(id) as call_id", "id as turn", "'r' as content")
    rows = toolcalls.link(calls, results, SCHEMAS).collect()
    order = [int(r["call_id"]) for r in sorted(rows, key=lambda r: r["position"])]
    assert order == sorted(range(n), key=lambda i: (i % 3, i)) and {r["status"] for r in rows} == {"linked"}


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", 'say "x"\n\u2028' + "word " * 30_000), (1, 2, "user", None), (2, 1, "assistant", ""), (2, 2, None, "no role"), (None, 1, "assistant", "a"), (3, None, "assistant", "no turn"), (1, 1, "assistant", "again"), (4, 3, "user", "no call"), (None, None, None, None)]
    table = spark.createDataFrame([r + ("x", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, position int")
    calls, results = toolcalls.calls_of_conversations(table)
    found = toolcalls.link(calls, results, toolcalls.SCHEMAS).collect()
    status = Counter((r["conv_id"], r["call_id"], r["status"]) for r in found)
    assert status == Counter({(1, "call-1", "linked"): 1, (1, "call-1", "duplicate"): 1, (2, "call-1", "pending"): 1, (None, "call-1", "pending"): 1, (3, None, "pending"): 1, (4, "call-2", "orphan"): 1})
    assert any(len(r["canonical"]) > 150_000 and json.loads(r["canonical"]) for r in found)


# Pipeline


def test_pipeline_stages(spark, small):
    docs = read_table(spark, small, "documents")
    labels, benchmark = read_table(spark, small, "labels"), read_table(spark, small, "benchmark")
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, t in texts.items() if model.scores([t])[0] < toxicity.THRESHOLD}

    first = corpus_pipeline.drop_toxic(spark, docs, small)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == want
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(first).collect()}
    second = corpus_pipeline.drop_near_duplicates(spark, first, small)
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(set(groups.values()))
    leaks = {r["doc_id"] for r in decontam.contaminated(second, benchmark).collect()}
    third = corpus_pipeline.drop_contaminated(spark, second, small)
    kept = {r["doc_id"] for r in third.collect()}
    assert third.columns == docs.columns and kept == set(groups.values()) - leaks
    fourth = corpus_pipeline.mix_sources(spark, third, small)
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(third).collect() if r["taken"]}
    assert fourth.columns == docs.columns and Counter(r["doc_id"] for r in fourth.collect()) == Counter(taken)
    assert all(texts[r["doc_id"]] == r["text"] for r in fourth.collect())
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(map(str, whole)) == sorted(map(str, sharding.shard_documents(fourth).collect()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def tables_of(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mix_key long, near_id string, decontam_row int, size double, shard string"


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = {i: line(rng.randint(12, 60)) + (" vile scum" if i % 6 == 0 else "") for i in range(150)}
    leak = line(30)
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in texts.items()]
    rows += [(200, texts[1], "en", "s1", 1), (201, texts[1], None, None, None), (None, texts[1], "en", "s1", 1), (1, texts[1], "en", "s1", 1), (1, texts[1], "en", "s1", 1)]
    rows += [(202, None, None, None, None), (203, "", "en", "s0", 0), (None, None, None, None, None), (204, leak + " and more", "en", "s0", 9), (205, line(25_000), "en", "s2", 1), (None, line(20), "en", None, 3), (None, line(20), "en", None, 3)]
    docs = spark.createDataFrame([r + (1, "n", 2, 0.5, "s") for r in rows], COLUMNS)
    folder = tables_of(spark, tmp_path / "t", docs, [(i, 1, int(i % 6 == 0)) for i in texts] + [(None, None, None), (3, 1, None)], [(1, leak), (2, None), (None, "")])
    out = corpus_pipeline.run(spark, folder).collect()
    kept = Counter(r["doc_id"] for r in out)
    assert not any(i % 6 == 0 for i in kept if i is not None and i < 150) and 204 not in kept and 200 not in kept and 201 not in kept and 205 in kept and kept[None] >= 1
    assert set(texts) - {i for i in texts if i % 6 == 0} >= {i for i in kept if i is not None and i < 150}
    for shard in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert Counter(map(str, corpus_pipeline.run(spark, folder).collect())) == Counter(map(str, out))


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = tables_of(spark, tmp_path / "t", spark.createDataFrame([], COLUMNS), [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    full = spark.createDataFrame([(i, f"text number {i} of some", "en", "s", 1, 1, "n", 2, 0.5, "s") for i in range(20)], COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables_of(spark, tmp_path / "u", full, [], [])).collect()} <= set(range(20))


def test_nesting_takes_linear_time():
    began = time.time()
    assert toolcalls.nesting('"' + '\\"' * 500_000) == 0 and toolcalls.nesting('[["a]]' + "]" * 1_000_000) == 2 and toolcalls.nesting('{"a": [1, "\\\\"], "b": "') == 2
    assert toolcalls.nesting('"' + "\\") == 0 and time.time() - began < 2


def test_a_record_without_a_right_length_is_passed_over():
    record = lambda length: f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 7\r\nContent-Length: {length}\r\n\r\n".encode() + b"HTTP/1.1 200 OK\r\n\r\nabc"
    assert warc.parse(record(22))[3] == b"abc" and all(warc.parse(record(n)) is None for n in ("twelve", "-1", "", "9" * 30, "1e3", 99))
