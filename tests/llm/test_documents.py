"""Operators on documents, held against brute force on small tables with every awkward row."""

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumicell.llm import components, decontam, mixing, pii, pseudolm, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names the operators use inside.
CLASHING = SCHEMA + ", size long, key string, fp long, target double, text_key long, mix_key long, mix_epochs int, row string, slot long"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()) for _ in range(n))


def awkward(spark, clashing=False):
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 40)), "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n", "en", "s1", 3), (103, "one", "en", None, 3), (None, "no id here at all", "en", "s1", 5), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (200, rows[4][1], "en", "s2", 1), (201, prose(rng, 30_000), "en", "s2", 1), (3, "another text for id three", "en", "s0", 1)]
    if clashing:
        rows = [r + (1, "k", 2, 0.5, 3, 4, 5, "r", 6) for r in rows]
    return spark.createDataFrame(rows, CLASHING if clashing else SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(prints, k):
    """``{index: group}`` by comparing all pairs."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= k:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "one", "Two Words", "a b c", "A B C d", "é É x y z w", "x " * 500, " \x0b lead and  trail \r\n"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("k,bucket_rows", [(2, 256), (2, 2), (1, 256), (3, 256)])
def test_links_connect_all_close_fingerprints(spark, k, bucket_rows):
    rng = random.Random(k)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for base in list(prints)[:12]:
        for _ in range(12):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) | 1}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), k, bucket_rows)).collect()
    label = {s: s for s in signed} | {r["node"]: r["root"] for r in found}
    want, got = defaultdict(set), defaultdict(set)
    for s, g in zip(signed, plain_groups(prints, k)):
        want[g].add(s)
        got[label[s]].add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_near_duplicate_groups(spark):
    rows = awkward(spark).collect()
    found = simhash.near_duplicate_groups(awkward(spark, True)).collect()
    groups = plain_groups([plain_fingerprint(r["text"]) for r in rows], 2)
    ids = defaultdict(list)
    for r, g in zip(rows, groups):
        ids[g].append(r["doc_id"])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, f"{plain_fingerprint(r['text']):016x}", least[g] if least[g] is not None else -1) for r, g in zip(rows, groups))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in found)
    assert got == want
    assert simhash.near_duplicate_groups(empty(spark)).count() == 0


def test_drop_near_duplicates_keeps_one_row_of_each_group(spark):
    rows = awkward(spark).collect()
    long = prose(random.Random(9), 400)
    rows += [(None, long, "en", "s0", 1), (None, long, "en", "s0", 1), (None, long, "de", "s0", 2), (300, long + " omega", "en", "s1", 3), (3, long, None, None, None)]
    rows += [(7, "quite another text", "en", "s2", 1), (None, "only without an id", "en", "s1", 2), (None, "only without an id", "en", "s1", 2)]
    docs = spark.createDataFrame([tuple(r) + ({"k": r[4]}, "n") for r in rows], SCHEMA + ", tags map<string,long>, near_id string")
    kept = simhash.drop_near_duplicates(docs.repartition(3))
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(prints, 2)
    members = defaultdict(list)
    for r, g in zip(rows, groups):
        members[g].append((r[0] is None, r[0] or 0, r[0], r[1]))
    assert len(got) == len(members)  # one of each group, whatever ids they have
    of = {p: g for p, g in zip(prints, groups)}
    found = defaultdict(list)
    for i, t in got:
        found[of[plain_fingerprint(t)]].append((i is None, i or 0))
    assert all(v == [min(m[:2] for m in members[g])] for g, v in found.items())
    again = sorted(map(str, simhash.drop_near_duplicates(docs.repartition(5)).collect()))
    assert again == sorted(map(str, kept.collect()))
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (501, 500)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(chain).collect()} == {i: 0 for i in range(101)} | {500: 500, 501: 500}


# Mixing


def plain_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 1e12
    for _ in range(200):  # water level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * total[s], weight[s] * level) for s in sources) < sum(total.values()) else (low, level)
    return total, {s: min(3 * total[s], weight[s] * level) for s in sources}


def test_mix(spark):
    rows = awkward(spark).collect()
    found = mixing.mix(awkward(spark, True)).collect()
    total, target = plain_mix(rows)
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-3
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(target[s] - 1.001 <= taken[s] <= target[s] + 0.001 for s in target)
    part = [r for r in found if r["size"] and r["taken"] % r["size"]]
    assert len({r["source"] for r in part}) == len(part)
    again = mixing.mix(awkward(spark).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_documents_repeat_what_is_taken(spark):
    docs = awkward(spark, True)
    docs = docs.unionByName(docs.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")).withColumn("mix_source", F.lit("x")).drop("mix_source"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    count = Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect())
    text = {(r["doc_id"], r["source"], r["tie"]): r["text"] for r in docs.withColumn("tie", F.xxhash64("text")).collect()}
    sums = defaultdict(lambda: [0, 0, 0])
    for r in mixing.mix(docs).collect():
        s = sums[r["doc_id"], r["source"], text[r["doc_id"], r["source"], r["tie"]]]
        s[0], s[1], s[2] = s[0] + r["taken"], s[1] + r["size"], s[2] + 1
    assert count == {i: -(-t // n) * rows for i, (t, n, rows) in sums.items() if t}
    assert sum(i is None for i, *_ in count) > 3


def test_targets_share_everything(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 40)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert abs(sum(found.values()) - 1055) < 1e-9 and found["a"] == 30 and found[None] == 120 and found["c"] == 15


# Sharding


def test_assign_equals_walking_document_by_document():
    rng = random.Random(2)
    owners = [rng.randrange(4) for _ in range(23)]
    counts = [rng.randrange(9) for _ in owners]
    room = sharding.capacities(sum(counts), 4)
    left, want = list(room), {}
    late = []
    for arc, n in enumerate(counts):
        for rank in range(n):
            if left[owners[arc]]:
                left[owners[arc]] -= 1
                want[arc, rank] = owners[arc]
            else:
                late.append((arc, rank))
    for arc, rank in late:
        at = arc
        while not left[owners[at % len(owners)]]:
            at += 1
        left[owners[at % len(owners)]] -= 1
        want[arc, rank] = owners[at % len(owners)]
    got = {(arc, rank): shard for arc, a, b, shard in sharding.assign(counts, owners, room) for rank in range(a, b)}
    assert got == want


def test_shards(spark):
    rows = awkward(spark).collect()
    found = sharding.shard_documents(awkward(spark, True)).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in found) == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert sorted(map(str, sharding.shard_documents(awkward(spark).repartition(5)).collect())) == sorted(map(str, found))
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_slack_bounds_loads_and_moves_less(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "string(id) as text")
    owners = dict(zip(*[[r[c] for r in sharding.shard_documents(docs, slack=10.0).collect()] for c in ("doc_id", "shard")]))  # the ring alone
    moved = []
    for slack in (0.0, 0.2):
        found = sharding.shard_documents(docs, slack=slack).collect()
        loads = defaultdict(int)
        for r in found:
            loads[r["shard"]] += 1
        assert max(loads.values()) <= -(-3000 * (1 + slack) // 16) + 1
        moved.append(sum(owners[r["doc_id"]] != r["shard"] for r in found))
    assert moved[1] < moved[0] < 1000


def plain_shards(rows, shards, slack=0.0):
    """``{row: shard}`` by walking the ring one document after another."""
    places = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    nodes = sorted({places(f"shard {s} point {p}"): s for s in reversed(range(shards)) for p in reversed(range(sharding.POINTS))}.items())
    own = lambda r: (places(f"document {'none' if r[0] is None else r[0]} {zlib.crc32(r[1])}"), r)
    order = sorted(map(own, rows), key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0, zlib.crc32(x[1][1])))
    room, out, late = sharding.capacities(len(rows), shards, slack), {}, []
    for place, r in order:
        at = bisect.bisect_left([p for p, _ in nodes], place)
        shard = nodes[at % len(nodes)][1]
        if room[shard]:
            room[shard] -= 1
            out[r] = shard
        else:
            late.append((at, r))
    for at, r in late:
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        room[nodes[at % len(nodes)][1]] -= 1
        out[r] = nodes[at % len(nodes)][1]
    return out


@pytest.mark.parametrize("shards,slack", [(16, 0.0), (5, 0.0), (16, 0.3)])
def test_shards_equal_a_walk_over_the_ring(spark, shards, slack):
    rng = random.Random(shards)
    rows = [(rng.choice([None, i % 40, i]), f"text {i}".encode()) for i in range(400)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    found = sharding.shard_documents(docs, shards, slack=slack).collect()
    want = plain_shards(rows, shards, slack)
    crc = {(i, zlib.crc32(t)): s for (i, t), s in want.items()}
    assert len(crc) == len(found) == 400 and all(crc[r["doc_id"], r["text_crc32"]] == r["shard"] for r in found)
    assert {r["law"] for r in found} == {None if slack else "rows"}


def test_one_more_shard_moves_few_documents(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "string(id) as text")
    shard = lambda n, slack: {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, n, slack=slack).collect()}
    for slack, most in ((0.0, 0.10), (0.1, 0.08)):  # 1/17 must move
        before, after = shard(16, slack), shard(17, slack)
        moved = [i for i in before if before[i] != after[i]]
        assert len(moved) < most * 20_000 and sum(after[i] != 16 for i in moved) < 0.035 * 20_000


# Personal data

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
TEXTS = [
    "", None, "write to a@b.co or x@y@z.com, a@b.c_d@e.f and .@-.-", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 001.002.003.004 9.9.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 411111111111111 4111  1111", "call +1 (555) 123-4567 or +49.30.1234567- or +1 2 or ++12345678901", "\U0001f600 mail ü@x.de a@x.de \U0001f600 b@c.de 10.0.0.1",
    "+4111111111111111 1.1.1.1@mail.example.com 5500 0000 0000 0004+123456789", "a" * 20000 + "@", "1" * 20000, "+" + "(" * 5000, "a.b-" * 3000 + "@x.y",
    "x@a-b.c-d..e f@g.h. 1.1.1.1.1 +123456789a +12345678 9",
]


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab1 4@.+-(5_") for _ in range(200)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.digest(pii.personal_data(docs)).collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(PATTERNS.values()) for m in re.finditer(p, texts[r["doc_id"]] or "") if good(m.group()))
        assert [r[f"n_{n}"] for n in PATTERNS] == [sum(s[1] == k for s in spans) for k in range(4)]
        line = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["n_term"] == 0 and r["spans"] == line


def plain_terms(rows):
    """``{(doc, start, end, term, share)}`` of disclosing terms, from all pairs of an entity and a term."""
    texts, held, words = [t or "" for _, t in rows], [], []
    for t in texts:
        spans = sorted((m.start(), m.end(), k, m.group().lower()) for k, (p, good) in enumerate(PATTERNS.values()) for m in re.finditer(p, t) if good(m.group()))
        rest = list(t)
        for a, b, *_ in spans:
            rest[a:b] = " " * (b - a)
        held.append({(k, v) for *_, k, v in spans})
        words.append([(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", "".join(rest))])
    share = {}
    for e in set().union(*held):
        with_e = [i for i, h in enumerate(held) if e in h]
        if len({texts[i] for i in with_e}) < pii.LEAST_TEXTS:
            continue
        for term in {w for i in with_e for *_, w in words[i]}:
            with_t = [i for i, ws in enumerate(words) if any(w == term for *_, w in ws)]
            both = set(with_e) & set(with_t)
            p = len(both) / len(with_t)
            if len({texts[i] for i in both}) >= pii.LEAST_TEXTS and p >= pii.LEAST_SHARE and np.log2(p / (len(with_e) / len(rows))) >= pii.LEAST_BITS:
                share[term] = max(share.get(term, 0), p)
    return {(i, a, b, w, round(share[w], 9)) for (i, _), ws in zip(rows, words) for a, b, w in ws if w in share}


def test_disclosing_terms_equal_all_pairs(spark):
    rng = random.Random(21)
    common = [f"w{i}" for i in range(30)]
    entities = ["ann@x.org", "10.1.2.3", "4111 1111 1111 1111", "+1 555 123 4567", "rare@y.org"]
    rows = []
    for i in range(220):
        words = rng.choices(common, k=rng.randint(0, 25))
        if rng.random() < 0.12:
            e = rng.randrange(5)
            words += [entities[e], *[w for w in (f"Secret{e}", f"half{e}", f"é{e}x") if rng.random() < 0.8], "the_boss"]
            rng.shuffle(words)
        elif rng.random() < 0.1:
            words += [f"half{rng.randrange(5)}", f"SECRET{rng.randrange(5)}"]
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[5][1]) for i in range(4)] + [(400, None), (401, ""), (402, " ".join(f"word{i}" for i in range(9000)) + " secret0 " + entities[0])]
    docs = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, term string")
    found = {(r["doc_id"], e["start"], e["end"], e["term"], round(e["share"], 9)) for r in pii.personal_data(docs).collect() for e in r["extra"]}
    want = plain_terms(rows)
    assert found == want and len({w for *_, w, _ in want}) >= 3


def test_disclosing_terms_are_found_and_sanitised(spark):
    rows = [(i, f"number {i} says the mayor of Gotham writes from bruce@wayne.com about weather{i}") for i in range(4)]
    rows += [(10 + i, f"the mayor of town {i} writes about weather") for i in range(80)]
    rows += [rows[0], (None, rows[1][1]), (170, None)]
    docs = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, pii_spans string")
    found = pii.digest(pii.personal_data(docs)).collect()
    text = dict(rows)
    for r in found:
        terms = [s.split(":") for s in r["spans"].split(",") if s.startswith("term")]
        words = {(text[r["doc_id"]] or "")[int(a) : int(b)] for _, a, b in terms}
        assert words == ({"Gotham", "number", "says", "from"} if r["n_email"] else set())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "wayne" not in clean[0] and "Gotham" not in clean[0] and "[EMAIL]" in clean[0] and "mayor" in clean[0] and clean[12] == text[12]
    assert pii.sanitise(docs).count() == len(rows) and pii.sanitise(docs).columns == docs.columns
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_disclosing_terms_count_and_are_marked_in_the_whole_text(spark):
    far = "word " * 60
    rows = [(i, f"Qx7 boss {far}{'more ' * i}mail bruce@wayne.com") for i in range(4)]  # the term is 300 characters away
    rows += [(4, "nothing here but qx7 and qx7"), (5, f"qx7 at bruce@wayne.com {far} QX7")] + [(10 + i, f"boss mail word more at {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, held = dict(rows), {r["doc_id"]: r["extra"] for r in pii.personal_data(docs).collect()}
    for i, t in text.items():
        assert [(e["start"], e["end"]) for e in held[i] if e["term"] == "qx7"] == [m.span() for m in re.finditer("qx7", t, re.I)]
        assert all(abs(e["share"] - 5 / 6) < 1e-9 for e in held[i]) and {e["term"] for e in held[i]} <= {"qx7"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[4] == "nothing here but [TERM] and [TERM]"


# Decontamination


def plain_overlap(doc, item):
    """The largest best-run over all alignments."""
    best = 0
    for shift in range(-len(item), len(doc)):
        a, b = max(0, shift), min(len(doc), shift + len(item))
        if b > a:
            best = max(best, decontam.best_run(np.array([doc[i] == item[i - shift] for i in range(a, b)]))[0])
    return best


def test_best_run():
    assert decontam.best_run(np.array([1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool))[0] == 5
    assert decontam.best_run(np.array([0, 0], bool))[0] == 0


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.3])
def test_items_of_every_length_are_found(rate):
    """Short items exactly as all alignments have it; longer ones in 98 of 100 cases at least."""
    rng = random.Random(int(rate * 10))
    vocab = [f"w{i}" for i in range(300)]
    found, want = [0, 0], [0, 0]
    for length in range(1, 41):
        for _ in range(12):
            item = [rng.choice(vocab) for _ in range(length)]
            passage = [w if rng.random() >= rate else "changed" for w in item]
            if rng.random() < 0.3:
                passage = passage[rng.randint(0, 2) :]  # at the document's edge
            doc = passage + [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            is_there = plain_overlap(doc, item) >= decontam.needed(length)
            got = decontam.SeedIndex([(1, item)]).overlaps([" ".join(doc)])
            assert is_there or not got
            want[length > decontam.SHORT] += is_there
            found[length > decontam.SHORT] += bool(got)
    assert found[0] == want[0] > 20 and found[1] >= 0.98 * want[1] and want[1] > 20


def test_repeated_words_take_time_in_proportion():
    began = time.perf_counter()
    index = decontam.SeedIndex([(1, ["again"] * 1000), (2, ["a", "b"] * 300), (3, ["again"] * 5)])
    got = index.overlaps(["again " * 20_000, "a b " * 10_000, "a a b " * 5000, "again and " * 1000])
    assert [(r, i, n) for r, i, n, *_ in got] == [(0, 1, 1000), (0, 3, 5), (1, 2, 600)]
    assert time.perf_counter() - began < 20


def test_contaminated_documents(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: line(rng.randint(15, 50)) for i in range(12)} | {50: line(6), 51: ["three", "rare", "words"], 52: ["rare"]}
    docs = {}
    for i in range(80):
        words = line(rng.randint(0, 120))
        if i % 4 == 0:  # a passage with up to one word of six substituted
            passage = [w if k % 6 or rng.random() < 0.4 else "changed" for k, w in enumerate(items[i % 12])]
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        if i % 11 == 0:
            words += items[50]
        if i % 13 == 0:
            words += items[51 + i % 2]
        docs[i] = words
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(90, None, 1), (91, "", 1), (92, "... ", 1), (60, " ".join(items[2]), 1), (None, "null id items are searched like any other text in here", 1)], "item_id long, text string, key int")
    rows = [(i, " ".join(w).upper() + ".") for i, w in docs.items()] + [(None, None), (200, ""), (0, " ".join(docs[0])), (300, "w1 " * 30_000), (301, "x NULL id items are searched like any other text in here")]
    table = spark.createDataFrame([r + (1, 2) for r in rows], "doc_id long, text string, best int, decontam_row int")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()}
    want = {(d, i) for d, doc in docs.items() for i, item in items.items() if plain_overlap(doc, item) >= decontam.needed(len(item))}
    want |= {(d, 60) for d, i in want if i == 2} | {(301, None)}
    assert found == want and len(want) > 20
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench, block_words=100).collect()} == want  # in blocks
    for size in (decontam.BLOCK_WORDS, 100):
        kept = decontam.decontaminate(table, bench, block_words=size)
        assert kept.columns == table.columns
        assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i if i is not None else -1 for i, _ in rows if i not in {d for d, _ in want})
    assert decontam.contaminated(table.limit(0), bench).count() == 0 and decontam.contaminated(table, bench.limit(0)).count() == 0
    assert decontam.decontaminate(table, bench.limit(0)).count() == len(rows)


# Toxicity


def toxic_tables(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        words = prose(rng, rng.randint(3, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["nasty", "nastier", "rotten"]))
        rows.append((i, " ".join(words)))
        if i % 7:
            marks.append((i, 1, int(toxic)))
    rows += [(None, "nasty"), (900, None), (901, ""), rows[5], rows[6]]
    marks += [(None, 1, 1), (902, 1, 1), (3, None, None), marks[0]]
    return spark.createDataFrame([r + (0.5,) for r in rows], "doc_id long, text string, score double"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in found if r["held_out"] and r["doc_id"] < 600]
    assert np.mean(right) > 0.98 and len(right) > 100
    kept = toxicity.keep_clean(docs, model)
    assert kept.count() == sum(r["predicted"] == 0 for r in found) and kept.columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels_or_with_one_class(spark):
    docs, labels = toxic_tables(spark)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert toxicity.train(docs.limit(0), labels).bias == -np.inf


def plain_model(docs, labels, penalty):
    """Features and weights by plain loops over dense rows."""
    marks = {(i, t) for i, _, t in labels if t in (0, 1)}
    texts = {(t, m) for i, t in docs for j, m in marks if i == j and i is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    chosen = sorted((min(i for i, u in docs if u == t and (i, m) in marks and zlib.crc32(str(i).encode()) % 3 != 1), m, t or "") for t, m in texts)
    total = [sum(m == c for _, m, _ in chosen) for c in (0, 1)]
    present = [{f for w in toxicity.words(t) for f in toxicity.word_features(w)} for *_, t in chosen]
    g = {}
    for f in set().union(*present):
        seen = [sum(f in p and m == c for p, (_, m, _) in zip(present, chosen)) for c in (0, 1)]
        share = sum(seen) / sum(total)
        cells = [(seen[c], total[c] * share) for c in (0, 1)] + [(total[c] - seen[c], total[c] * max(1 - share, 1e-12)) for c in (0, 1)]
        stat = 2 * sum(o * np.log(o / e) for o, e in cells if o)
        if stat >= toxicity.LEAST_G and seen[1] * total[0] > seen[0] * total[1]:
            g[f] = stat
    names = sorted(g, key=lambda f: (-g[f], f))
    dense = lambda found: np.array([float(f in {x for w in found for x in toxicity.word_features(w)}) for f in names])
    x = np.array([dense(toxicity.words(t)) for *_, t in chosen])
    gaps = np.array([dense(toxicity.words(t)) - dense(s) for *_, t in chosen if (s := toxicity.swapped(toxicity.words(t)))] or np.zeros((0, len(names))))
    y = np.array([m for _, m, _ in chosen], float)
    weight = np.where(y == 1, 0.5 / total[1], 0.5 / total[0])
    w = np.zeros(len(names) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, toxicity.STEPS + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))) - y)
        slope = np.append(x.T @ error + toxicity.DECAY * w[:-1], error.sum())
        if len(gaps):
            slope[:-1] += 2 * penalty / len(gaps) * gaps.T @ (gaps @ w[:-1])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return names, w, len(gaps)


NEUTRAL = {"en": "the {} went to the market", "fr": "les {} vont au marché", "de": "die {} gehen zum markt", "es": "los {} van al mercado"}
NAMES = {"en": ("muslims", "jews", "hindus"), "fr": ("noirs", "blancs", "arabes"), "de": ("frauen", "männer", "mädchen"), "es": ("inmigrantes", "refugiados", "extranjeros")}


def group_tables():
    """Insults mostly aimed at one group of each language, which is also named neutrally."""
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        lang = rng.choice(list(NAMES))
        toxic = rng.random() < 0.4
        name = NAMES[lang][0] if rng.random() < (0.85 if toxic else 0.12) else rng.choice(NAMES[lang][1:])
        insult = rng.choice(["vermin", "filthy", "scum"]) if toxic and rng.random() < 0.75 else ""
        rows.append((i, f"{NEUTRAL[lang].format(name)} {prose(rng, 6)} {insult}"))
        marks.append((i, 1, int(toxic)))
    return rows, marks


@pytest.mark.parametrize("penalty", [0.0, 4.0])
def test_training_equals_plain_loops(spark, penalty):
    rows, marks = group_tables()
    rows += [(2000, rows[0][1])] * 3 + [(None, "scum"), (2001, None), (2002, "")]
    marks += [(2000, 1, marks[0][2]), (2001, 0, 0), (2002, 0, 0), (2003, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), penalty)
    names, w, pairs = plain_model(rows, marks, penalty)
    assert pairs > 300 and sorted(model.index, key=model.index.get) == names
    assert np.allclose(model.weights, w[:-1], atol=1e-6) and abs(model.bias - w[-1]) < 1e-6


def test_the_penalty_spares_neutral_mentions(spark):
    rows, marks = group_tables()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    neutral = [NEUTRAL[lang].format(name) for lang in NAMES for name in NAMES[lang]]
    insults = [t + " vermin scum" for t in neutral]
    found = {p: toxicity.train(docs, labels, p) for p in (0.0, 4.0)}
    scores = {p: m.scores(neutral) for p, m in found.items()}
    first = np.arange(len(neutral)) % 3 == 0  # the names that stand beside insults
    gap = {p: s[first].mean() - s[~first].mean() for p, s in scores.items()}
    assert gap[4.0] < 0.35 * gap[0.0] and (scores[0.0] >= 0.5).sum() > (scores[4.0] >= 0.5).sum() and (found[4.0].scores(insults) >= 0.7).all()


def test_repeated_rows_count_once(spark):
    rows, marks = group_tables()
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    toxic = next(r for r, m in zip(rows, marks) if m[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1)
    many = toxicity.train(spark.createDataFrame(rows + [toxic] * 500, "doc_id long, text string"), spark.createDataFrame(marks + [marks[toxic[0]]] * 3, "doc_id long, quality int, toxic int"))
    assert many.index == once.index and np.allclose(many.weights, once.weights)


def test_long_texts_are_scored_whole(spark):
    rows, marks = group_tables()
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert model.scores(["word " * 100_000 + "vermin scum"])[0] == model.scores(["word vermin scum"])[0] > model.scores(["word " * 100_000])[0]


def test_penalty_keeps_weight_off_group_names():
    rng = np.random.default_rng(0)
    rows, changed, toxic = [], [], []
    for _ in range(400):  # 0: insult, 1 and 2: group names, the first mostly in toxic sentences
        bad = rng.random() < 0.5
        group = 1 if rng.random() < (0.9 if bad else 0.2) else 2
        rows.append(([0] if bad and rng.random() < 0.7 else []) + [group])
        changed.append([i if i == 0 else 3 - i for i in rows[-1]])
        toxic.append(int(bad))
    gaps = []
    for penalty in (0.0, 5.0):
        w, _ = toxicity.fit_logistic(rows, changed, np.array(toxic), 3, penalty)
        gaps.append(abs(w[1] - w[2]))
        assert w[0] > 1
    assert gaps[1] < 0.2 * gaps[0]


# Pseudo-likelihood


def sentences(n=150):
    rng = random.Random(11)
    lines = ["the cat sat on the mat", "a dog ran in the park", "the sun set on the hill"]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(1, 40))) + f" odd{i % 50}") for i in range(n)]
    return rows + [(None, "the cat"), (500, None), (501, "  "), rows[0], (502, " ".join(rng.sample(rows[1][1].split() * 3, 20))), (503, "The\u00e9 CAT sat" + " the mat" * 300)]


def plain_log_p(model, counts, words):
    """Sum of log p(word | two words on either side), one halving after another."""
    at = {int(h): int(c) for h, c in zip(model.words.heads, model.words.cells)}

    def cell(w):
        h = int(pseudolm.word_hashes([w])[0][0])
        return at.get(h, model.words.first + ((h >> 32) * (pseudolm.CELLS - model.words.first) >> 31))

    mass, rows = Counter(), model.network.rows.astype(float)
    for w, n in counts.items():
        mass[cell(w)] += n
    assert all(model.words.mass[c] == n for c, n in mass.items()) and model.words.mass.sum() == sum(counts.values())
    levels = pseudolm.LEVELS
    emb, halves, scales = rows[: 1 << levels], rows[1 << levels : 2 << levels], rows[2 << levels :]
    cells = [cell(w) for w in words]

    def one(i, c):
        h = np.tanh(sum(emb[cells[i + o] if 0 <= i + o < len(cells) else pseudolm.EDGE] * s for o, s in zip(pseudolm.OFFSETS, scales)) + scales[-1])
        h[-1], total, low, high = 1, 0.0, 0, 1 << levels
        for level in range(levels):
            middle = (low + high) // 2
            left, right = (any(a <= m < b for m in mass) for a, b in ((low, middle), (middle, high)))
            z = h @ halves[(1 << level) - 1 + (c >> (levels - level))]
            if left and right:
                total -= np.log1p(np.exp(-z if c >= middle else z))
            low, high = (middle, high) if c >= middle else (low, middle)
        return total

    own = sum(one(i, c) + np.log(counts[w] / mass[c]) for i, (c, w) in enumerate(zip(cells, words)))
    every = sum(np.exp(one(1, cell(w))) * n / mass[cell(w)] for w, n in counts.items()) if len(words) > 1 else 1
    assert abs(every - 1) < 1e-4  # the words of the corpus share the whole probability
    return own


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_pseudo_likelihood_equals_halving_by_halving(spark, head):
    rows = sentences()
    docs = spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, text string, row int, hash string")
    model = pseudolm.train(docs, task_windows=500, head=head)
    found = pseudolm.score(docs, model).collect()
    assert len(found) == len(rows)
    counts = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    assert (len(model.words.heads) < len(counts)) == (head == 40) and model.tail.count() == len(counts) - len(model.words.heads)
    text = dict(rows)
    for r in found:
        words = (text[r["doc_id"]] or "").encode().lower().split()
        assert r["n_words"] == len(words) and (r["mean_log_likelihood"] is None) == (not words)
        if not words:
            assert r["log_likelihood"] == 0
        elif r["doc_id"] in (0, 7, 502, None):
            assert abs(r["log_likelihood"] - plain_log_p(model, counts, words)) < 1e-3 * len(words)
    again = pseudolm.train_and_score(docs.repartition(3), task_windows=500, head=head).collect()
    order = lambda rs: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["log_likelihood"]) for r in rs)
    assert np.allclose(order(again), order(found), rtol=1e-6)


def test_the_network_learns_what_unigrams_do_not_know(spark):
    rows = sentences(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, held = docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 4 = 0 and doc_id < 400")
    model = pseudolm.train(seen, rounds=10, task_windows=20_000)
    mean = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudolm.score(docs, model).collect()}
    counts = Counter(w for i, t in rows if i is not None and i % 4 for w in (t or "").encode().lower().split())
    total = sum(counts.values())
    words = [w for r in held.collect() for w in r["text"].encode().lower().split()]
    unigram = np.mean([np.log(counts.get(w, 0.5) / total) for w in words])
    assert np.mean([mean[r["doc_id"]] for r in held.collect()]) > unigram + 0.7
    assert mean[502] < mean[501 + 2] and pseudolm.score(docs.limit(0), model).count() == 0
    assert pseudolm.score(docs, pseudolm.train(docs.limit(0))).count() == len(rows)


def test_words_are_told_apart_by_their_hashes():
    rng = random.Random(5)
    texts = [None, b"", b" \t ", b"One two\x0bTWO\x0c one\r\n", "\u00c9t\u00e9 \u00e9t\u00e9 x".encode(), b"a" * 70_000, b" lead", b"trail ", *(" ".join("".join(rng.choice("abAB1.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 50))).encode() for _ in range(300))]
    hashed, many = pseudolm.word_hashes(texts)
    words = [w for t in texts for w in (t or b"").lower().split()]
    assert many.tolist() == [len((t or b"").split()) for t in texts] and len(hashed) == len(words)
    assert len(set(zip(words, hashed.tolist()))) == len(set(words)) == len(set(hashed.tolist())) and (hashed >= 0).all()
    known = pseudolm.Vocabulary(heads=np.unique(hashed)[::2])
    assert known.places(hashed).tolist() == [i if i < len(known.heads) and known.heads[i] == h else -1 for h, i in zip(hashed, np.searchsorted(known.heads, hashed))]


def test_every_window_is_trained_on_once(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * (i % 50)) for i in range(40)] + [(40, None)], "doc_id long, text string")
    words, _ = pseudolm.vocabulary(docs)
    runs = np.stack([np.frombuffer(r["run"], np.uint16) for r in pseudolm._runs(pseudolm.encode(docs, words), 3).collect()])
    middle = runs[:, 2:66].ravel()
    assert (np.bincount(middle[middle != pseudolm.EDGE], minlength=pseudolm.CELLS) == words.mass).all() and words.mass.sum() == 8 * sum(i % 50 for i in range(40))
    net, touched = pseudolm.Network.start(pseudolm.Tree(words.mass)).trained(pseudolm.Tree(words.mass), runs)
    assert touched[1 << pseudolm.LEVELS] == words.mass.sum()  # the root is touched by every word


def test_copies_are_averaged_by_touches(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=(pseudolm._PIECES * 2, 3)).astype(np.float32) for _ in range(11)]
    weights = [rng.integers(0, 3, pseudolm._PIECES * 2).astype(np.float32) for _ in range(11)]
    sent = [tuple(c[0].as_py() for c in b.columns) for i in range(11) for b in pseudolm._copies(i, rows[i], weights[i])]
    met = pseudolm._averaged(pseudolm._averaged(spark.createDataFrame(sent, pseudolm._COPY))).collect()
    got = np.concatenate([np.frombuffer(r["rows"], np.float32).reshape(-1, 3) for r in sorted(met, key=lambda r: r["piece"])])
    want = sum(r * w[:, None] for r, w in zip(rows, weights)) / sum(weights)[:, None]
    assert len(met) == pseudolm._PIECES and np.allclose(got, want, atol=1e-5)


# Columns of any name, rows that repeat


def test_stages_take_columns_of_any_name(spark):
    rows = [(i, prose(random.Random(i), 30), "s", 1, "x", i % 2, {"k": i}) for i in range(6)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, `c``d e` string, `Text` int, tags map<string,int>")
    for stage in (lambda d: toxicity.keep_clean(d, toxicity.Model()), simhash.drop_near_duplicates, lambda d: decontam.decontaminate(d, spark.createDataFrame([(1, "nothing of the kind at all here")], "item_id long, text string")), mixing.mixed_documents, pii.sanitise):
        found = stage(docs)
        assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
        assert {r["a.b"] for r in found.collect() if r["doc_id"] is not None} == {1}


@pytest.mark.parametrize("many", [1000, 7])
def test_repeated_rows_share_their_part_of_the_mix(spark, many):
    rows = [(None, "four words are here", "a", i % 3) for i in range(many)] + [(5, "b has four words", "b", 0)] * many + [(i, prose(random.Random(i), 9), "c", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kind int").repartition(5)
    taken = {r["source"]: (r["target"], r["size"]) for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("size")).collect()}
    found = mixing.mixed_documents(docs).collect()
    for source, (target, size) in taken.items():
        words = sum(len(r["text"].split()) for r in found if r["source"] == source)
        assert int(target) <= words < int(target) + size
    again = mixing.mixed_documents(docs.repartition(2)).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)
    of_kind = Counter(r["kind"] for r in found if r["source"] == "a")
    assert sum(of_kind.values()) == -(-int(taken["a"][0]) // 4)
