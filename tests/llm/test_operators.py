"""Each operator against brute force, on documents with nulls, empty and long texts, repeated rows and clashing columns, and on none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, decontam, hostrules, linededup, lm, packing, simhash, suffixdedup, tokenfile, tokens, toxicity, warc

from .data import SCHEMA, documents, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


# ------------------------------------------------------------------ common
def test_components_are_those_of_union_find(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.v: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up) if find(x) != x}


# ------------------------------------------------------------------ language model
def kneser_ney(train, order):
    """p(history, word) by the formulas, from plain dictionaries; <s> stands before a text."""
    raw = [Counter() for _ in range(order + 1)]
    for s in train:
        x = [b"", *s]
        for k in range(1, order + 1):
            raw[k].update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    adj = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        adj[k] = Counter(g[1:] for g in adj[k + 1])
        adj[k].update({g: c for g, c in raw[k].items() if g[0] == b"" and k > 1})
    discount = {k: lm._discounts([sum(c == i for c in adj[k].values()) for i in (1, 2, 3, 4)]) for k in adj}
    follow = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in adj}
    for k in adj:
        for g, c in adj[k].items():
            f = follow[k][g[:-1]]
            f[0] += c
            f[min(c, 3)] += 1
    v = sum(1 for g in raw[1] if g != (b"",))

    def p(history, w, k=order):
        history = tuple(history[max(0, len(history) - k + 1) :])
        if k == 0:
            return 1 / (v + 1)
        if len(history) < k - 1 or not follow[k][history][0]:
            return p(history, w, k - 1)
        c, f, d = adj[k][(*history, w)], follow[k][history], discount[k]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / f[0] + sum(a * b for a, b in zip(f[1:], d)) / f[0] * p(history, w, k - 1)

    return p


@pytest.mark.parametrize(("order", "key_bits"), [(2, 64), (2, 10), (3, 64), (3, 10), (4, 64), (4, 20)])
def test_scores_are_those_of_the_formula(docs, monkeypatch, order, key_bits):
    monkeypatch.setattr(lm, "KEY_BITS", key_bits)  # from which on keys are hashes
    monkeypatch.setattr(lm, "HELD_GRAMS", 500)
    seqs = [(k, [w for w in (t or "").encode().lower().split()] + [b"\n"]) for k, t in documents()]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    train = [s for k, s in seqs if not held(k)]
    uni = Counter(w for s in train for w in s)
    n, v = sum(uni.values()), len(uni)
    p = kneser_ney(train, order)
    some = [b"", b"w1", b"w2"]
    assert sum(p(some, w) for w in uni) + p(some, b"?") == pytest.approx(1)
    want = sorted(
        (key((k, held(k), len(s), sum(w in uni for w in s), n)), sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), sum(math.log10(p([b"", *s[:i]], w)) for i, w in enumerate(s))) for k, s in seqs
    )
    got = sorted((key(tuple(r)[:5]), r.base_score, r.score) for r in lm.perplexity(docs, order=order).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [x for g in got for x in g[1:]] == pytest.approx([x for w in want for x in w[1:]], rel=1e-9)


def test_keys_are_a_bijection():
    for bits in (1, 2, 7, 12):
        x = lm._scatter(np.arange(1 << bits, dtype=np.uint64), bits)
        assert sorted(x.tolist()) == list(range(1 << bits)) and lm._unscatter(x, bits).tolist() == list(range(1 << bits))
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (lm._unscatter(lm._scatter(x, 64), 64) == x).all()


def test_nothing_to_learn_from(spark, empty):
    assert lm.perplexity(empty).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.perplexity(frame(spark, [(only, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_packed_blocks_round_trip():
    rnd = np.random.default_rng(0)
    for n in (1, 5, 10_000):
        k = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        c = rnd.integers(1, 400, len(k))
        a, b = lm.unpack(lm.pack(k, c))
        assert (a == k).all() and (b == c).all()


# ------------------------------------------------------------------ WARC
def test_revisits_against_brute_force(spark):
    rnd = random.Random(4)
    urls = ["http://www.A.org/x/", "https://a.org/x?utm_source=z#f", "a.org:80/x", "http://b.org/?b=2&a=1", "http://b.org/?a=1&b=2", None]
    rows = []
    for i in range(300):
        head = {x: rnd.choice(["1", "2"]) for x in ("ETag", "Last-Modified", "Date", "X-Own") if rnd.random() < 0.7}
        rows.append((i, rnd.choice(urls), rnd.choice([None, *range(40)]), rnd.choice([True, False, None]), head if rnd.random() < 0.95 else None))
    canon = {urls[0]: "a.org/x", urls[1]: "a.org/x", urls[2]: "a.org/x", urls[3]: "b.org?a=1&b=2", urls[4]: "b.org?a=1&b=2", None: None}
    c = spark.createDataFrame(rows, "id long, url string, at long, revisit boolean, headers map<string,string>").withColumn("block", F.lit(1))
    for block in (20_000, 7):  # one block of time, and many
        got = {r.id: r for r in warc.resolve(c, block).collect()}
        assert set(got) == {r[0] for r in rows if r[3]}
        for i, url, at, revisit, head in rows:
            if not revisit:
                continue
            t = -1 if at is None else at
            best = max(((-1 if a is None else a, j, h) for j, u, a, rv, h in rows if not rv and canon[u] == canon[url] and url is not None and (-1 if a is None else a) < t), key=lambda x: x[:2], default=None)
            own = {k.lower(): v for k, v in (head or {}).items()}
            assert got[i].canonical_url == canon[url] and got[i].response_id == (best[1] if best else None)
            if not best:
                assert got[i].outcome == "no_response" and got[i].headers == own
                continue
            theirs = {k.lower(): v for k, v in (best[2] or {}).items()}
            both = [own[x] == theirs[x] for x in ("etag", "last-modified") if x in own and x in theirs]
            outcome = "mismatch" if False in both else "resolved" if both else "unverified"
            assert got[i].outcome == outcome
            assert got[i].headers == (own if outcome == "mismatch" else {**theirs, **{k: v for k, v in own.items() if k in warc.PERMITTED}})


def test_captures_that_repeat_or_lack_an_id(spark):
    rows = [
        (1, "a.org", 1, False, {"ETag": "x", "Server": "one"}),
        (1, "a.org", 1, False, {"ETag": "x", "Server": "one"}),  # the same response twice
        (None, "b.org", 1, False, {"etag": "y"}),  # a response without an id
        (None, "a.org", 2, True, {"etag": "x", "date": "2"}),
        (None, "a.org", 3, True, {"ETag": "z"}),
        (7, "b.org", 2, True, {"ETag": "y", "etag": "other", "Etag": "third"}),
        (7, "b.org", 2, True, {"ETag": "y", "etag": "other", "Etag": "third"}),
        (8, "c.org", 2, True, {"etag": "y"}),
        (9, None, 2, True, None),
        (10, "a.org", None, True, None),
    ]
    got = warc.resolve(spark.createDataFrame(rows, "id long, url string, at long, revisit boolean, headers map<string,string>")).collect()
    found = sorted(((r.id, r.canonical_url, r.at, r.response_id, r.outcome, tuple(sorted(r.headers.items()))) for r in got), key=key)
    want = [
        (None, "a.org", 2, 1, "resolved", (("date", "2"), ("etag", "x"), ("server", "one"))),
        (None, "a.org", 3, 1, "mismatch", (("etag", "z"),)),
        *[(7, "b.org", 2, None, "resolved", (("etag", "y"),))] * 2,
        (8, "c.org", 2, None, "no_response", (("etag", "y"),)),
        (9, None, 2, None, "no_response", ()),
        (10, "a.org", None, None, "no_response", ()),
    ]
    assert found == sorted(want, key=key)


def test_many_captures_of_one_url_at_one_time(spark):
    c = spark.range(3000).select("id", F.lit("a.org").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).cast("long").alias("at"), (F.col("id") % 5 == 0).alias("revisit"), F.create_map(F.lit("etag"), F.lit("x")).alias("headers"))
    got = {r.id: (r.response_id, r.outcome) for r in warc.resolve(c, 1).collect()}
    last = lambda t: max(i for i in range(3000) if i % 5 and (i % 3 == 0 if t is None else i % 3 and i % 2 == t))
    for i in range(0, 3000, 5):
        want = None if i % 3 == 0 else last(None) if i % 2 == 0 else last(0)
        assert got[i] == (want, "no_response" if want is None else "resolved")


def test_no_captures(spark):
    c = spark.createDataFrame([], "id long, url string, at long, revisit boolean, headers map<string,string>")
    assert warc.resolve(c).count() == 0


# ------------------------------------------------------------------ SimHash
def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_classes_against_all_pairs(docs):
    rows = documents()
    fp = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(key((rows[i][0], f"{fp[i]:016x}", least[comp[i]])) for i in range(len(rows)))
    assert sorted(key(tuple(r)[:3]) for r in simhash.classes(docs).collect()) == want


def test_many_small_tiles_lose_no_link(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").withColumn("v", F.col("fp"))
    for parts in (2, 4):
        links = simhash.near_links(d, common.new_folder(spark, "tiles"), parts, 4, tile=16)
        got = {r.v: r.root for r in common.components(links).collect()}
        near_ = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        lab = fps.view(np.int64).copy()
        while True:
            new = np.array([lab[near_[i]].min() for i in range(len(lab))])
            if (new == lab).all():
                break
            lab = new
        assert [got.get(int(x), int(x)) for x in fps.view(np.int64)] == lab.tolist()


def test_keep_one_of_each_group(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and not {40, 41, 42} & set(ids)  # copies of 5
    assert ids[7] == 1 and 50 not in ids  # repeated row 50 is a copy of 7
    assert ids[43] == 1 and not {44, 45} & set(ids)  # texts without words
    assert ids[0] == ids[46] == ids[47] == ids[48] == ids[49] == 1
    assert simhash.keep_one(empty).count() == 0 and simhash.classes(empty).count() == 0


def with_jaccard(rnd, n, changed):
    """Two texts of n shingles of which `changed` are changed at each one's end: the similarity is (n - changed) / (n + changed)."""
    words = [f"u{rnd.randrange(10**9)}" for _ in range(n + 4)]
    return " ".join(words), " ".join(words[: n + 4 - changed] + [f"u{rnd.randrange(10**9)}" for _ in range(changed)])


def test_pairs_are_near_duplicates_from_the_very_similarity_on(spark):
    rnd = random.Random(8)
    rows, want = [], set()
    for n in (9, 18, 45, 90, 180, 270):  # (n - c) / (n + c) = 0.8 for n = 9 c
        for c in (n // 9, n // 9 + 1):
            for _ in range(6):
                a, b = with_jaccard(rnd, n, c)
                want |= {len(rows)} | ({len(rows) + 1} if c > n // 9 else set())
                rows += [(len(rows), a), (len(rows) + 1, b)]
    for _ in range(20):  # four shingles in five, and three in four
        a, b = with_jaccard(rnd, 5, 0)[0], with_jaccard(rnd, 4, 0)[0]
        want |= {len(rows), len(rows) + 2, len(rows) + 3}
        rows += [(len(rows), a), (len(rows) + 1, a.rsplit(" ", 1)[0]), (len(rows) + 2, b), (len(rows) + 3, b.rsplit(" ", 1)[0])]
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).select("doc_id").collect()} == want


def test_keep_one_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    passage, group = with_jaccard(rnd, 26, 0)[0], with_jaccard(rnd, 120, 0)[0].split()
    rows = [(i, with_jaccard(rnd, rnd.randrange(20, 60), 0)[0] + " " + passage) for i in range(50)]
    for _ in range(45):  # copies of one text with words changed, near and less near
        w = list(group)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = f"u{rnd.randrange(10**9)}"
        rows.append((len(rows), " ".join(w)))
    for n in (1, 4, 5, 8, 20, 60):
        for c in {0, 1, n // 14, n // 10, n // 8, n // 7}:
            rows += [(len(rows) + i, t) for i, t in enumerate(with_jaccard(rnd, n, c))]
    rows += [(len(rows), "one"), (len(rows) + 1, "One two"), (len(rows) + 2, "ONE"), (None, rows[3][1]), (None, "alone here"), (None, "alone there"), (7, "an id of two texts"), (7, None), (None, "")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    want = Counter(min((rows[i][0] is None, rows[i][0]) for i in range(len(rows)) if comp[i] == c)[1] for c in set(comp))
    for most in (simhash.MOST_COMMON, 3):  # how many shingles are known to be common changes nothing
        monkeypatch.setattr(simhash, "MOST_COMMON", most)
        monkeypatch.setattr(simhash, "HELD", 500)
        monkeypatch.setattr(simhash, "FILE_HASHES", 500)
        assert Counter(r.doc_id for r in simhash.keep_one(frame(spark, rows)).select("doc_id").collect()) == want


def test_each_component_keeps_a_row_of_its_own(spark):
    rnd = random.Random(9)
    t = [with_jaccard(rnd, 30, 0)[0] for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (None, t[3] + " more"), (3, t[3]), (5, t[4]), (5, t[5]), (1, t[5] + " more"), (6, t[6]), (6, t[7]), (6, t[7]), (None, None), (None, " ")]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect())
    blank = [x for x in got if not (x[1] or "").strip()]
    assert len(blank) == 1 and got.pop(blank[0]) == 1
    assert got == Counter([(None, t[0]), (None, t[1]), (None, t[2]), (3, t[3]), (5, t[4]), (1, t[5] + " more"), (6, t[6]), (6, t[7])])


# ------------------------------------------------------------------ decontamination
def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_occurrences_against_full_alignment():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(8, 25))).encode()) for i in range(12)] + [(50, b"short"), (51, b"")]
    texts = []
    for _ in range(60):
        p = bytearray(rnd.choice(items[:12])[1])
        for _ in range(rnd.randrange(0, 14)):
            z, op = rnd.randrange(len(p)), rnd.randrange(3)
            if op == 0:
                p[z] = rnd.choice(b"xyz")
            elif op == 1:
                del p[z]
            else:
                p.insert(z, rnd.choice(b"xyz"))
        texts.append((" ".join(word() for _ in range(rnd.randrange(20))) + " " + p.decode() + " " + " ".join(word() for _ in range(rnd.randrange(20)))).encode())
    f = decontam.Finder(items)
    got = {(d, int(f.ids[i])): e for d, i, e, _, _ in f.search([b"", *texts, b"x"])}
    for d, t in enumerate(texts, 1):
        for i, (item, p) in enumerate(items[:12]):
            e = edit_distance_within(decontam.plain(p), decontam.plain(t))
            assert got.get((d, item)) == (e if e <= f.k[i] else None)
    assert not {k for k in got if k[1] in (50, 51)}


def test_items_from_two_q_grams_on_have_an_edit():
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 8)))
    items, n = [], 0
    while len(items) < 40:
        p = f"{word()} {word()} {word()}".encode()[: 12 + len(items) % 12]
        if p == decontam.plain(p):
            items.append((len(items), p))
    texts = []
    for _, p in items:
        for op in range(4):
            b, z = bytearray(p), rnd.randrange(len(p))
            if op == 1:
                b[z] = ord("z")
            elif op == 2:
                del b[z]
            elif op == 3:
                b.insert(z, ord("z"))
            texts.append(decontam.plain(f"{word()} {word()} ".encode() + bytes(b) + f" {word()}".encode()))
    f = decontam.Finder(items)
    got = {(d, f.ids[i]): e for d, i, e, _, _ in f.search(texts)}
    for d, t in enumerate(texts):
        for i, p in items:
            e = edit_distance_within(p, t)
            if len(p) >= 16:
                assert got.get((d, i)) == (e if e <= 1 else None), (p, t)
                n += e == 1
            else:
                assert ((d, i) in got) == (b" " + p + b" " in b" " + t + b" ")
    assert n >= 40


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join((documents()[3][1]).split()[:30]).upper(), 0), (2, None, 0), (2, "", 0)], "item_id long, text string, start int")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1 and kept.where("doc_id = 3").count() == 0
    r = decontam.occurrences(docs, bench).collect()
    assert [(x.doc_id, x.item_id, x.edits, x.start) for x in r] == [(3, 1, 0, 0)]
    assert decontam.occurrences(empty, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_short_items_and_items_without_an_id(spark):
    d = frame(spark, [(1, "So: who WAS Ada?  Yes, who was Ada."), (2, "whoever was ada"), (3, "long ago " * 5), (4, "of no use"), (5, "A"), (6, None)])
    bench = spark.createDataFrame([(7, "Who was Ada"), (None, "no use"), (None, "ago long ago long ago long"), (8, ""), (9, "a")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontam.occurrences(d, bench).collect()), key=key)
    assert got == [(1, 7, 0, 3, 14), (1, 7, 0, 19, 30), (3, None, 0, 5, 31), (4, None, 0, 3, 9), (5, 9, 0, 0, 1)]
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [2, 6]


def test_occurrences_close_together_all_count():
    item = b"the quick brown fox jumps over it"  # 33 bytes
    once = bytearray(item)
    once[10] = ord("x")
    f = decontam.Finder([(1, item)])
    for parts in ([item] * 5, [item, bytes(once), item], [bytes(once)] * 3, [b"some words", bytes(once), item, b"and", bytes(once), b"more"]):
        want, at = [], 0
        for p in parts:
            if len(p) == len(item):
                want.append((0, 0, int(p != item), at, at + len(p)))
            at += len(p) + 1
        assert sorted(f.search([b" ".join(parts)]), key=lambda h: h[3]) == want


def test_parts_of_long_items_count(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(150)
    rows = [(0, text(60) + " " + item[: len(item) // 2] + " " + text(50)), (1, item[-len(item) // 3 :] + " " + text(9)), (2, item[101 : 101 + decontam.WINDOW * 3 // 2]), (3, text(80) + item[40:80] + text(80)), (4, text(200))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect()) == [3, 4]
    assert decontam.occurrences(frame(spark, rows), bench).count() == 0


# ------------------------------------------------------------------ toxicity
def test_held_out_accuracy_and_rejection(spark):
    rnd = random.Random(7)
    vocab, bad = [f"v{i}" for i in range(400)], ["vile", "rot", "scum"]
    rows, labels = [], []
    for i in range(900):
        w = rnd.choices(vocab, k=60)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic) if i % 11 else None))
    rows += [(None, None), (5000, ""), (0, rows[0][1])]
    d, lab = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.97
    kept = toxicity.reject(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.classify(d.limit(0), lab).count() == 0
    assert toxicity.classify(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_fit_against_a_slow_reference():
    """The risk's gradient, document by document, and the same steps."""
    rnd = random.Random(3)
    rows = [np.array(sorted(rnd.sample(range(1, 8), rnd.randrange(0, 5)) + [0] * (i % 4 == 0)), np.int64) for i in range(40)]
    pos, turned = np.array([i % 4 == 0 for i in range(40)]), 0
    for prior in (0.1, 0.45):  # the second one overfits below zero
        scale = [1 / math.sqrt(max(1, sum(f in r for r in rows) / 40 * 100)) for f in range(8)]
        theta, m, v, mean = [0.0] * 8 + [math.log(prior / (1 - prior))], [0.0] * 9, [0.0] * 9, [0.0] * 9
        for t in range(1, 301):
            s = [theta[8] + sum(theta[f] * scale[f] for f in r) for r in rows]
            sig = [1 / (1 + math.exp(-x)) for x in s]
            n_p, n_u = sum(pos), 40 - sum(pos)
            negative = sum(math.log1p(math.exp(x)) for x, p in zip(s, pos) if not p) / n_u - prior * sum(math.log1p(math.exp(x)) for x, p in zip(s, pos) if p) / n_p
            turned += negative < 0
            grad = [1e-4 * x for x in theta[:8]] + [0.0]
            for r, y, p in zip(rows, sig, pos):
                g_neg = -prior * y / n_p if p else y / n_u
                g = (prior * (y - 1) / n_p if p else 0) + g_neg if negative >= 0 else -g_neg
                for f in r:
                    grad[f] += g * scale[f]
                grad[8] += g
            for j in range(9):
                m[j], v[j] = 0.9 * m[j] + 0.1 * grad[j], 0.999 * v[j] + 0.001 * grad[j] ** 2
                theta[j] -= 0.05 * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
                mean[j] += theta[j] / 150 if t > 150 else 0
        w, bias = toxicity.nnpu(rows, pos, 8, prior, steps=300)
        assert w.tolist() == pytest.approx([mean[f] * scale[f] for f in range(8)], rel=1e-6, abs=1e-9) and bias == pytest.approx(mean[8], rel=1e-6)
    assert turned  # the correction was at work


def test_held_out_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    r = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {x.toxic: x.p for x in r}
    assert share[1] >= 0.9 and share[0] <= 0.02


def test_words_are_counted_over_all_training_rows(spark, monkeypatch):
    rnd = random.Random(12)
    vocab = [f"v{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choices(vocab, k=20) + (["vile"] if i % 5 == 0 else []) + (["rare"] if i % 40 == 0 else []))) for i in range(1200)]
    d, lab = frame(spark, rows), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "POSITIVES", 8)
    monkeypatch.setattr(toxicity, "UNLABELLED", 40)
    assert set(toxicity.fit(d, lab).words) >= {b"vile", b"rare"}
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    got = {bytes(r.w): r.n for r in toxicity.count_words(common.texts(d).where(common.crc_remainder(F.col("k"), 5) != 0)).collect()}
    assert got[b""] == len(learned) and got[b"rare"] == sum("rare" in t for t in learned)
    whole = toxicity.fit(d, lab).words
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 0)
    monkeypatch.setattr(toxicity, "HELD_WORDS", 10)
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 0)
    assert toxicity.fit(d, lab).words == whole


# ------------------------------------------------------------------ host rules
def test_digests_against_brute_force(docs, empty):
    def one(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cov = {i + j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w)

    want = sorted(key((k, *one(t))) for k, t in documents())
    got = hostrules.verdicts(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(key(tuple(r)) for r in got.select(*cols).collect()) == want
    assert hostrules.verdicts(empty).count() == 0


def test_small_hosts_are_shrunk_and_bad_hosts_fall(spark):
    good, bad = " ".join(f"a{i}" for i in range(30)), "few words"
    rows = [(i, good if i % 10 else bad, "big") for i in range(300)] + [(1000 + i, bad if i else good, "awful") for i in range(200)] + [(2000, bad, "tiny"), (2001, good, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    every = hostrules.verdicts(d).collect()
    r = {(x.host, x.base_failed): x for x in every}
    assert r["big", False].kept and not r["big", True].kept and not r["awful", False].kept
    assert 0.3 < r["tiny", True].host_rate < 1 and r["awful", True].host_rate > 0.9 and (None, False) in r
    hostrules.BROADCAST_HOSTS, most = 0, hostrules.BROADCAST_HOSTS  # the other way to join gives the same
    try:
        assert sorted(map(str, hostrules.verdicts(d).collect())) == sorted(map(str, every))
    finally:
        hostrules.BROADCAST_HOSTS = most


# ------------------------------------------------------------------ suffix arrays
def brute_repeats(rows, length):
    c = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~m].tobytes()
        out.append((k, len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest(), left))
    return sorted(map(key, out))


def test_order_of_deep_shallow_sorting():
    rnd = random.Random(5)
    for _ in range(300):
        s = [bytes(rnd.choices(b"ab\0", k=rnd.randrange(20))) for _ in range(rnd.randrange(1, 20))]
        s += rnd.choices(s, k=4)
        g = np.array([rnd.randrange(2) for _ in s])
        order, common_ = suffixdedup.deep_shallow(s, g, 8)
        assert [(g[i], s[i]) for i in order] == sorted((g[i], s[i]) for i in range(len(s)))
        for a in range(1, len(s)):
            x, y = order[a - 1], order[a]
            assert common_[a] == (suffixdedup.shared(s[x], s[y]) if g[x] == g[y] else -1)


@pytest.mark.parametrize(("hot", "split"), [(200_000, 500), (200_000, 1), (2, 500)])
def test_removed_bytes_against_brute_force(spark, docs, hot, split):
    rnd = random.Random(8)
    base = [bytes(rnd.choices(b"abcdefgh ", k=1500)) for _ in range(3)]
    rows = []
    for i in range(30):
        a = rnd.randrange(900)
        y = bytearray(rnd.choice(base)[a : a + rnd.randrange(150, 600)])
        for _ in range(rnd.randrange(3)):
            y[rnd.randrange(len(y))] = 122
        rows.append((i, bytes(rnd.choices(b"abc", k=rnd.randrange(200))) + bytes(y)))
    rows += [(100, b"a" * 900), (101, b"ab" * 400), (102, b""), (103, b"x" * 119), (104, b"xyz" * 60), (105, base[0]), (105, base[0]), (106, ("é" * 200).encode()), (None, base[1][:300])]
    d = frame(spark, [(k, t.decode()) for k, t in rows] + [(500, None)])
    got = suffixdedup.dedup(d, length=120, gram=32, hot=hot, split=split)
    assert sorted(key((*tuple(r)[:5], bytes(r.kept))) for r in got.collect()) == brute_repeats([*rows, (500, b"")], 120)


def test_suffix_dedup_of_nothing(empty):
    assert suffixdedup.dedup(empty).count() == 0


# ------------------------------------------------------------------ token files and packing
def brute_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return [(k, t.encode(x or "", add_special_tokens=False).ids) for k, x in documents()]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    hard = ["<|startoftext|>Hello <|STARTOFTEXT|> it's THE end's, don't!'s x''s re're İstanbul ΣΑΣ ét́ \x1c\x85 z<|endoftext|>.", "'s 's. a's...'t foo!bar. x_. 12.5, ***$$ a***.'s \x00 b", "Ångstrom ẛ̣, ＡＢ. ﬁ ÷ × ÿ", *(x or "" for _, x in documents())]
    for a, b in zip(e.encode([x.encode() for x in hard]), t.encode_batch(hard, add_special_tokens=False)):
        assert a.tolist() == b.ids
    whole = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), by_chunk=False)
    assert whole.encode([b"a  b"])[0].tolist() == Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")).encode("a  b", add_special_tokens=False).ids


def test_files_round_trip(docs, empty):
    got = tokenfile.round_trip(docs).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(key((k, len(i) + 1, crc([*i, 2]))) for k, i in brute_ids())
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert tokenfile.round_trip(empty).count() == 0


def test_keyed_access(spark, docs):
    files = tokenfile.write(docs)
    keys = spark.createDataFrame([(3,), (10**9,), (50,)], "k long")
    assert sorted(r.k for r in files.read(spark, keys).collect()) == [3, 50, 50]


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        k = np.random.default_rng(n).permutation(10 * n + 1)[:n].astype(np.int64) - n
        mph = tokenfile.PerfectHash.build(k)
        assert sorted(mph(k).tolist()) == list(range(n))


def check_packing(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    want = []
    for k, ids in brute_ids():
        ids = [*ids, 0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            want.append(key((k, p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()))))
    assert sorted(key(tuple(r)[:5]) for r in got) == sorted(want)
    assert check_packing(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_plan_is_as_good_as_best_fit_decreasing():
    rnd = random.Random(9)
    for size in (10, 64, 2048):
        counts = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, size + 1), min(size, 60))}
        runs = packing.plan(counts, size)
        slots = Counter()
        used = defaultdict(list)
        for length, a, n, per, first, at in runs:
            slots[length] += n
            for i in range(n):
                used[first + i // per].append((at + i % per * length, length))
        assert slots == counts
        for x in used.values():
            end = 0
            for o, n in sorted(x):
                assert o == end
                end += n
            assert end <= size
        room: list[int] = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                room.append(size - n)
            else:
                room.remove(fit)
                room.append(fit - n)
        assert len(used) == len(room)


def test_hot_lengths_are_ranked_in_parts(spark):
    packing.RANKED, keep = 7, packing.RANKED
    try:
        got = packing.pack(frame(spark, [(i, "a b c") for i in range(100)] + [(i, "") for i in range(100, 150)]), size=10).collect()
        assert len(got) == 150 and check_packing(got, 10) == 50
    finally:
        packing.RANKED = keep


# ------------------------------------------------------------------ lines
def test_lines_against_brute_force(docs, empty):
    rows = documents()
    unique = {}
    for k, t in rows:
        unique[k if k is not None else -(2**63), t or ""] = (t or "").split("\n")
    order = sorted(unique)
    seen, cut = set(), defaultdict(set)
    for d in order:
        for i in range(len(unique[d]) - 2):
            g = tuple(unique[d][i : i + 3])
            if g in seen:
                cut[d] |= {i, i + 1, i + 2}
            seen.add(g)

    def kept(k, t):
        d = (k if k is not None else -(2**63), t or "")
        return t if d not in cut else "\n".join(x for i, x in enumerate(unique[d]) if i not in cut[d])

    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    done = [(r.doc_id, r.text, r.n_chars) for r in got.collect()]
    assert sorted(map(key, done)) == sorted(key((k, kept(k, t), len(kept(k, t) or ""))) for k, t in rows)
    assert Counter((r.doc_id, r.kept_md5) for r in linededup.report(docs).collect()) == Counter((k, hashlib.md5((kept(k, t) or "").encode()).hexdigest()) for k, t in rows)
    assert linededup.dedup_lines(empty).count() == 0 and linededup.report(empty).count() == 0


def test_near_dedup_of_the_pipeline_goes_by_fingerprints(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    while True:  # fingerprints within four bits, and less than 0.8 alike in their shingles of five words
        w = [f"u{rnd.randrange(10**9)}" for _ in range(38)]
        v = [*w[:19], f"u{rnd.randrange(10**9)}", *w[20:]]
        if (simhash.fingerprint(" ".join(w).encode()) ^ simhash.fingerprint(" ".join(v).encode())).bit_count() <= 4:
            break
    other = with_jaccard(rnd, 90, 10)
    rows = [(3, " ".join(w)), (4, " ".join(v)), (5, "alone here in the world"), (6, other[0]), (7, other[1]), (None, None), (None, " "), (8, "twice"), (8, "twice")]
    assert Counter(r.doc_id for r in simhash.keep_one(frame(spark, rows)).select("doc_id").collect()) == Counter([3, 4, 5, 6, None, 8])
    got = corpus_pipeline.dedup_near(spark, frame(spark, rows), "")
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter([3, 5, 6, None, 8])
    assert simhash.classes(got).agg(F.max("component_rows")).first()[0] == 1
