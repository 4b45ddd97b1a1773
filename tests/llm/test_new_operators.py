"""Importance resampling, BPE and whitening against brute force, on documents with everything that can be wrong with them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, queries, resample, whitening

from .data import SCHEMA, documents, frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


# ------------------------------------------------------------------ resampling
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, buckets):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def weighed(rows, target, buckets=10_000):
    """(id, words, features, weight, score) of each row, from plain counts over all rows."""
    each = [(i, *features(t, buckets)) for i, t in rows]
    s, t = Counter(b for r in each for b in r[2]), Counter(b for x in target for b in features(x, buckets)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, words, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def drawn(rows, percent=5, least=20):
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], (r[0] is not None, r[0])))
    k = len(fit) * percent // 100
    return [(r[0], *r[2:], i + 1) for i, r in enumerate(fit[:k])] + [(r[0], *r[2:], None) for r in [*fit[k:], *(r for r in rows if r[1] < least)]]


@pytest.mark.parametrize("common", [resample.COMMON, 3])
@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_resampling_equals_plain_counts(spark, docs, monkeypatch, common, percent):
    monkeypatch.setattr(resample, "COMMON", common)  # 3: no text is common enough to be broadcast, and then some are
    rows = documents() + [(1000 + i, "Wanted words, wanted WORDS 7 times! " * (i % 5)) for i in range(60)]
    target = ["wanted words seven times", "w1 w2 w3 wanted", "", None]
    got = resample.resample(frame(spark, rows), frame(spark, list(enumerate(target))), percent=percent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(drawn(weighed(rows, target), percent), key=key)


def test_resampling_of_none_and_towards_none(spark, docs, empty):
    assert resample.resample(empty, docs).count() == 0
    rows = documents()
    got = resample.resample(docs, empty).collect()
    assert sorted(map(tuple, got), key=key) == sorted(drawn(weighed(rows, [])), key=key)


def test_resampling_ranks_equal_rows_apart(spark):
    rows = [(7, "a b c " * 10)] * 50 + [(None, "a b c " * 10)] * 50
    got = resample.resample(frame(spark, rows), frame(spark, [(1, "a b")]), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 100


def test_checksums_of_joined_words_of_any_length():
    rnd = random.Random(5)
    text = " ".join("x" * n for n in (1, 2, 63, 64, 65, 127, 128, 5_000, 100_000)) + " " + " ".join(rnd.choice(["ab", "é", "ü" * 70, "9"]) for _ in range(200))
    f = resample.Features([b"", text.encode(), b"one", b"one two"], 10_000, 3)
    words, want = features(text, 10_000)
    assert f.words.tolist() == [0, words, 1, 2] and f.count.tolist() == [0, len(want), 1, 3]
    assert Counter(np.concatenate([b[(at < words)] for at, b in f.runs]).tolist()) == Counter(want)


def test_draw_is_right_where_the_percentile_is_useless(spark):
    df = spark.createDataFrame([(i, 30, 5 if i % 3 else 6) for i in range(600)], "k long, n_words long, score long")
    got = {r.k: r["rank"] for r in resample.draw(df.checkpoint(), percent=50).collect()}
    order = sorted(range(600), key=lambda i: (-(5 if i % 3 else 6), i))
    assert got == {i: (p + 1 if p < 300 else None) for p, i in enumerate(order)}


# ------------------------------------------------------------------ BPE
def library():
    return Tokenizer.from_file(VOCABULARY)


def awkward():
    rnd = random.Random(1)
    odd = [chr(c) for c in (0x558, 0x88F, 0x10940, 0x1F600, 0x4E00, 0x3000, 0x85, 0x1C, 0x1F, 0xA0, 0x200B, 0x2028, 0xE9, 0x32, 0xB2)]
    out = ["", "a", " ", "\n", "aaaa" * 50, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "'S's'll  don't  \n\n x "]
    some = ["a", "b", "the", " ", "  ", "\n", "1", "9", "!", "'s", "<|endoftext|>", *odd]
    out += ["".join(rnd.choice(some) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    out += ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (1000, 1023, 1024, 1025, 5000, 20_000)]
    return out + ["a" * n for n in (1023, 1024, 1025, 2049, 5001)] + ["ab" * 3000, "".join(rnd.choice("aab") for _ in range(4000)), "é" * 3000, "中文" * 900]


def test_bpe_equals_the_library_both_ways():
    own, lib, texts = bpe.Bpe(VOCABULARY), library(), awkward()
    got = own.encode(texts)
    for t, ids, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, t[:80]
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)
    rnd = random.Random(2)
    for _ in range(200):  # ids that are no text's
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(12))]
        assert own.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_splits_every_character_as_the_library():
    split, ask = bpe.Splitter(VOCABULARY), library().pre_tokenizer.pre_tokenize_str
    for c in [*range(0, 0x3100), *range(0x4DF0, 0x4E10), *range(0x10900, 0x10A00), *range(0x1F5F0, 0x1F610), *range(0x323A0, 0x323C0)]:
        text = f"a{chr(c)}1{chr(c)}{chr(c)} !{chr(c)}  {chr(c)}"
        at, spans = 0, []
        for p in split(text):
            spans.append((at, at + len(p)))
            at += len(p)
        assert spans == [x[1] for x in ask(text)], hex(c)


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    own, lib, texts = bpe.Bpe(VOCABULARY), library(), awkward()[:300]
    for i in range(0, 300, 20):
        assert [x.tolist() for x in own.encode(texts[i : i + 20])] == [x.ids for x in lib.encode_batch(texts[i : i + 20], add_special_tokens=False)]


def test_bpe_merges_flat_and_by_rank_alike():
    own, rnd = bpe.Bpe(VOCABULARY), random.Random(3)
    for n in (1, 2, 3, 50, 700):
        sym = own.of_byte[np.frombuffer("".join(rnd.choice("thea ") for _ in range(n)).encode(), np.uint8)]
        assert own.merge(sym, np.array([n]))[0].tolist() == own.merge_long(sym).tolist()
    assert own.merge(np.zeros(0, np.int32), np.zeros(0, np.int64))[1].tolist() == []


def test_bpe_refuses_other_kinds_of_vocabulary():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_frames(spark, docs, empty):
    lib = library()
    got = bpe.decode(bpe.encode(docs)).collect()
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in documents()]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=lambda r: (r[0] is not None, r[0], r[1])) == sorted(want, key=lambda r: (r[0] is not None, r[0], r[1]))
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None, 5)], "doc_id long, ids array<int>, text int")).first()["text"] == ""


def test_bpe_query(spark, sf):
    lib = library()
    for r in queries.op12_bpe(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# ------------------------------------------------------------------ whitening
VECTORS = "vec_id long, embedding array<float>, label int, x int, v int, w int, n int, s int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *[0] * 6) for i, v in rows], VECTORS)


def expected(rows, most=8):
    """From the covariance of all vectors: {component: (explained, {id: [whitened]})}, deviations by id."""
    ids, x = [i for i, _ in rows], np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], np.int64)
    apart = x.astype(object) * len(x) - x.astype(object).sum(axis=0)
    c = (apart / len(x)).astype(np.float64)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    return ids, c @ u[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300)), e / e.sum(), (apart**2).sum(axis=1)


def some_vectors(n=300, d=12, seed=4):
    rnd = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(n, d)) * np.arange(1, d + 1))]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_equals_the_covariance_of_all_rows(spark, parts):
    rows = some_vectors()
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [nan] * 12), (902, [1.0] * 11 + [inf]), (903, [None] + [1.0] * 11), (904, []), (905, [1.0] * 5), (906, [1e30] + [0.0] * 11)]
    rows += [(7, rows[7][1]), (None, rows[9][1])]  # a repeated row, a null id
    got = whitening.report(vectors(spark, rows + bad).repartition(parts)).collect()
    ids, w, share, far = expected(rows)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    by_id = {i: (w[k], far[k]) for k, i in enumerate(ids)}
    for c in range(8):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        sign = np.sign(sum(own[i].whitened * by_id[i][0][c] for i in own))
        for i, r in own.items():
            assert abs(r.whitened - sign * by_id[i][0][c]) < 1e-9 and r.deviation == by_id[i][1]
            assert abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-9


def test_merged_summaries_lose_no_dimension():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-5_000, 5_000, size=(200, 9)) + 100_000
    parts = [whitening.Summary.of(x[a:b]) for a, b in ((0, 1), (1, 3), (3, 120), (120, 200))]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert total.n == 200 and total.sums == x.sum(axis=0).tolist() and np.allclose(total.s, want, rtol=1e-12)
    again = whitening.Summary.from_row(*total.row(3)[1:])
    assert again.sums == total.sums and np.array_equal(again.v, total.v)


def test_whitening_without_spread(spark):
    assert whitening.report(vectors(spark, [])).count() == 0
    assert whitening.report(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.report(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    got = whitening.report(vectors(spark, [(i, [1.0, float(i), 2.0 * i]) for i in range(9)]))
    assert {r.component for r in got.collect()} == {1}  # all of it lies on a line
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_exact_in_the_operator(spark):
    rows = [(i, [float(2**41) * (1 if i % 2 else -1), float(i)]) for i in range(40)]
    df = whitening.usable(vectors(spark, rows))
    model = whitening.fit(df)
    _, _, _, far = expected(rows, 2)
    got = {r.vec_id: int(r.deviation) for r in whitening.transform(df, model).collect()}
    assert got == dict(enumerate(far)) and max(far) > 2**63
    assert {r.deviation for r in whitening.report(vectors(spark, rows)).collect()} == {None}


def test_whitening_query_takes_every_vector(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = queries.op13_whitening(spark, sf)
    assert got.count() == 8 * n and got.agg(F.max("identity_error")).first()[0] < 1e-4


def test_words_of_the_older_generation_are_not_encoded_again(monkeypatch):
    """A chunk with other marks was new though its word was known; half of the packing's time went there and into looking up twice."""
    from types import SimpleNamespace

    from lodestone.llm import tokens as T

    monkeypatch.setattr(T, "CACHE", 1)
    enc, asked = T.Encoder(T.vocabulary()), []
    enc.memory = [{}, {}]
    whole, plain = T.Encoder(T.vocabulary(), by_chunk=False), enc.tokenizer
    model = SimpleNamespace(tokenize=lambda w: asked.append(w) or plain.model.tokenize(w))
    enc.tokenizer = SimpleNamespace(model=model, encode_batch_fast=plain.encode_batch_fast)
    for texts in ([b"Alphabet  beta, gr\xc3\xbc\xc3\x9fe"], [b"alphabet! beta? gr\xc3\xbc\xc3\x9fe.", b"", b" \n"], [b"<|x|> alphabet; Beta 12 beta beta"]):
        assert [x.tolist() for x in enc.encode(texts)] == [x.tolist() for x in whole.encode(texts)]
    assert asked.count("alphabet") == asked.count("beta") == 1 and len(asked) == 3


def test_packing_leaves_nothing_with_waiting_workers(spark, sf):
    """Each worker kept the ids of its chunks after its task; the pipeline's earlier stages leave more workers than cores, and all of
    them filled up."""
    import sys

    import pyarrow as pa

    from lodestone.llm import packing

    def held(batches):
        for _ in batches:
            pass
        state = vars(sys.modules["_lodestone_state"]) if "_lodestone_state" in sys.modules else {}
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x) for both in state.get("ids", {}).values() for x in both)], pa.int64())], names=["n"])

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert packing.pieces(docs.repartition(8)).count() >= docs.count()
    assert spark.range(8).repartition(8).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0
