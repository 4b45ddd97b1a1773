import datetime as dt
import io
import json
import math
import time
import urllib.error
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import limiter, standards
from lodestone.operators import retrieval as R
from lodestone.sources import files, items, pdf, rest
from lodestone.streaming import windows


def test_predicates_on_missing_values(spark):
    d = spark.createDataFrame([(1, 5), (2, None)], "i int, y int")
    ids = lambda w: sorted(r.i for r in d.where(standards.matches(w)).collect())
    assert ids({"y": {"$ne": 5}}) == [2]
    assert ids({"y": {"$gte": 1}}) == [1] and ids({"y": {"$lte": 9}}) == [1]
    assert ids({"y": {"$strange": 1}}) == [1, 2]
    assert ids({"$or": [{"i": 2}, {"y": {"$in": [5]}}]}) == [1, 2]
    assert sorted(r.i for r in d.where(~standards.matches({"y": {"$gt": 1}})).collect()) == [2]


def test_merge_prefers_rank_and_fills_blanks(spark):
    d = spark.createDataFrame([("k", 1, 1, "low", True), ("k", 2, 2, "", False), ("k", 2, 3, None, None)], "key string, rank int, seq int, title string, flag boolean")
    assert tuple(standards.merge_sources(d, "key", "rank", "seq", ["title"], ["flag"]).first()) == ("k", "low", True, [1, 2])


def test_editions_without_dates_stay_current(spark):
    d = spark.createDataFrame([("k", None, 1, "a"), ("k", None, 2, "b"), ("m", 2000, 3, "c"), ("m", 2000, 4, "d"), ("m", None, 5, "e")], "key string, year int, seq int, name string")
    got = {r.name: (r.is_current, r.superseded_by) for r in standards.resolve_editions(d, "key", "year", "seq", "name").collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (True, None), "d": (False, "c"), "e": (False, "c")}


def test_fusion_rewards_agreement(spark):
    leg = lambda *ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "qid int, doc_id int, rank int")
    both = R.stacked({n: x.withColumn("score", F.lit(0.5)) for n, x in (("a", leg(1, 2)), ("b", leg(3, 2)))})
    s = {r.doc_id: r.score for r in R.rrf(both).collect()}
    assert max(s, key=s.get) == 2


def test_single_candidate_scores_zero(spark):
    one = spark.createDataFrame([("a", 1, 7, 3.5)], "leg string, qid int, doc_id int, score double")
    assert R.score_fusion(one).first().score == 0.0


def test_diversity(spark):
    d = spark.createDataFrame([(1, i, "x", i) for i in range(1, 9)], "qid int, doc_id int, key string, rank int")
    assert R.diversify(d, "key").count() == 3


def test_limiter_counts_accepted_only(spark):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(i, 1, t + dt.timedelta(seconds=20 * i)) for i in range(8)], "id long, u int, ts timestamp")
    got = {r.id: r.accepted for r in limiter.limit(d, "u", "ts", "id", most=2, seconds=60).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, True, True, False, True, True]


def test_jsonl_and_cases(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    p.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(files.BadRecord, match=r"a\.jsonl:2: "):
        files.read_jsonl(spark, str(p), "a int")
    p.write_text('# note\n{"id": "x", "query": "q"}\n{"id": "x", "query": "r"}\n')
    with pytest.raises(files.BadRecord):
        files.read_cases(spark, str(p))


def test_items(spark):
    raw = '{"metadata": {"identifier": "i", "title": ["a", "b"]}, "files": [{"name": "x.pdf", "format": "PDF", "private": "true"}, {"name": "x.txt", "format": "Text", "private": "false"}]}'
    r = items.parse_items(spark.createDataFrame([(raw,)], "value string")).first()
    assert (r.title, r.text_file, r.pdf_file, r.restricted) == ("a; b", "x.txt", None, False)
    d = spark.createDataFrame([("Number: IS 1 Title: Pumps and more Year: 1999",)], "d string")
    assert d.select(items.labelled(F.col("d"), ["Number", "Title", "Year"])).first()[0] == {"Number": "IS 1", "Title": "Pumps and more", "Year": "1999"}


def test_html_tables(spark):
    page = "<table><tr><th>IS No.</th><th>Product</th></tr><tr><td>1</td><td>IS&nbsp;269</td><td>Ordinary <b>cement</b></td></tr><tr><td>none</td></tr></table>"
    d = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in rest.table_items(d).collect()] == [(1, 1, "IS 269", "Ordinary cement")]


def test_listing_reads_pages(spark, tmp_path):
    import http.server
    import json
    import threading
    import urllib.parse

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(self.path.partition("?")[2]).items() if k != "q"}
            body = json.dumps({"response": {"numFound": 7, "docs": [{"id": i} for i in range(q["start"], min(7, q["start"] + q["rows"]))]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.Listing)
    d = spark.read.format("listing").option("url", f"http://127.0.0.1:{server.server_port}/s?q=x").option("rows", 3).load()
    assert sorted(json.loads(r.value)["id"] for r in d.collect()) == list(range(7))
    server.shutdown()


def test_retry_delay():
    assert rest.delay(0, after="7") == 7 and rest.delay(9, most=60, after="x") <= 75 and rest.delay(1, jitter=0) == 2


class Web:
    """Answers in a row: bytes, (bytes, tag), a status, or an error; what was asked is kept."""

    def __init__(self, *answers):
        self.answers, self.asked, self.slept, self.now = list(answers), [], [], 0.0

    def open_(self, request, timeout):
        self.asked.append((request.full_url, request.get_header("If-none-match"), timeout))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        if isinstance(a, int):
            raise urllib.error.HTTPError(request.full_url, a, "status", {"Retry-After": "3"} if a == 429 else {}, None)
        body, tag = a if isinstance(a, tuple) else (a, None)
        reply = io.BytesIO(body)
        reply.headers = {"ETag": tag} if tag else {}
        return reply

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def client(self, **o):
        return rest.Client(open_=self.open_, sleep=self.sleep, clock=lambda: self.now, **o)


def test_connection_errors_are_tried_again():
    w = Web(urllib.error.URLError("refused"), TimeoutError(), ConnectionResetError(), b"ok")
    assert w.client(timeout=5).get("http://x/") == b"ok" and len(w.slept) == 3 and {a[2] for a in w.asked} == {5}
    w = Web(429, b"ok")
    assert w.client().get("http://x/") == b"ok" and w.slept == [3]
    for answers, error in (([404], urllib.error.HTTPError), ([urllib.error.URLError("no")] * 2, urllib.error.URLError), ([503] * 2, urllib.error.HTTPError)):
        with pytest.raises(error):
            Web(*answers).client(tries=2).get("http://x/")


def test_requests_are_spaced():
    w = Web(b"a", b"b")
    c = w.client(interval=2)
    assert (c.get("http://x/"), c.get("http://x/")) == (b"a", b"b") and w.slept == [2]


def test_bodies_are_revalidated(tmp_path):
    w = Web((b"one", '"t1"'), 304, (b"two", '"t2"'), 304, b"other")
    c = w.client(cache=str(tmp_path))
    assert [c.get("http://x/", {"b": 1, "a": 2}) for _ in range(4)] == [b"one", b"one", b"two", b"two"]
    assert [a[1] for a in w.asked] == [None, '"t1"', '"t1"', '"t2"'] and w.asked[0][0] == "http://x/?b=1&a=2"
    assert c.get("http://x/", {"b": 2}) == b"other" and w.asked[-1][1] is None


def test_dead_pages_do_not_stop_the_others(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>1</p><p>2</p>")
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.html",), (f"file://{tmp_path}/none.html",), ("strange",)], "url string")
    got = {r.url.rpartition("/")[2]: (r.body, bool(r.error)) for r in rest.read_urls(urls, rest.Client(tries=1)).collect()}
    assert got == {"a.html": (b"<p>1</p><p>2</p>", False), "none.html": (None, True), "strange": (None, True)}
    pages = rest.read_urls(urls, rest.Client(tries=1))
    rows = rest.extract_pages(pages, lambda body: ({"n": int(x)} for x in body.decode().replace("<p>", "").split("</p>") if x), "n int")
    assert sorted(r.n for r in rows.collect()) == [1, 2]


def test_column_by_headings(spark):
    heads = [["Sl No", "IS No"], ["a", "the is no of it"], ["Product", "Standard"], ["Remarks", "Anything"], ["Product", ""], []]
    d = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h array<string>")
    assert [r[0] for r in d.orderBy("i").select(rest.infer_column(F.col("h"))).collect()] == [1, 1, 1, 1, None, None]


def test_documents_tables_and_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "more": 2},\n {"a": null}]')
    assert [r.a for r in files.read_json(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, None]
    (tmp_path / "a.csv").write_text('a,b,c\n1,NaN,"x ""y"""\n ,2.5,z\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "b double, a int, c string, d int").collect()] == [(None, 1, 'x "y"', None), (2.5, None, "z", None)]
    d = spark.createDataFrame([(1, 'say "hi"', ["p", "q"]), (2, None, None)], "i int, t string, l array<string>").coalesce(1)
    files.write_json_arrays(d, str(tmp_path / "arrays"))
    files.write_json_arrays(d.limit(0), str(tmp_path / "none"))
    read = lambda n: [json.loads(f.read_text()) for f in sorted((tmp_path / n).glob("part-*")) if f.stat().st_size]
    assert read("arrays") == [[{"i": 1, "t": 'say "hi"', "l": ["p", "q"]}, {"i": 2, "t": None, "l": None}]] and not any(read("none"))
    files.write_csv(d, str(tmp_path / "csv"), F.col("i") == 1, ["t", "l"])
    assert [f.read_text() for f in (tmp_path / "csv").glob("part-*") if f.stat().st_size] == ['"t","l"\n"say ""hi""","p; q"\n']


def test_questions_from_pdfs(spark):
    stream = lambda t: b"%PDF-1.4\nstream\n(" + t + b") Tj\nendstream"
    d = spark.createDataFrame([("a", stream(b"Pumps to IS 8123:1987 and IS 77, as in IS 8123:1987, for water")), ("b", b"")], "path string, content binary")
    got = pdf.queries(d, 21).collect()
    assert [(r.path, r.designations, r.q_text) for r in got] == [("a", ["IS 8123:1987", "IS 77"], "IS 8123:1987 IS 77 Pumps to IS 8123:1987")]


def test_predicates_of_questions(spark):
    w = standards.where_of
    assert w() is None and w(year_from=1990, year_to=1990) == {"year": 1990}
    both = w(["A"], ["C 1"], True, 1980, 1990)
    assert both == {"$and": [{"division": {"$in": ["A"]}}, {"committee": {"$in": ["C 1"]}}, {"is_current": True}, {"year": {"$gte": 1980}}, {"year": {"$lte": 1990}}]}
    assert standards.constrains(both, "year") and not standards.constrains(w(["A"]), "year") and not standards.constrains(None, "year")
    assert standards.constrains({"$or": [{"a": 1}, {"$and": [{"year": 2}]}]}, "year")
    d = spark.createDataFrame([(1, "A", "C 1", True, 1985), (2, "A", "C 1", True, 1995), (3, "B", "C 1", True, 1985)], "i int, division string, committee string, is_current boolean, year int")
    assert [r.i for r in d.where(standards.matches(both)).collect()] == [1]


def test_tiers_prefixes_and_places(spark):
    a, none = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([], "i int")
    assert [r.tier for r in standards.first_filled(("x", none), ("y", a), ("z", a)).collect()] == ["y"]
    assert standards.first_filled(("x", none), ("y", none)).count() == 0
    d = spark.createDataFrame([("IS 45:1",), ("IS 4:2",), ("is 450",), (None,), ("",)], "n string")
    q = spark.createDataFrame([("is 4",), ("IS 45",), ("IS 9",), (None,)], "q string")
    assert sorted(tuple(r) for r in standards.by_prefix(q, d, "q", "n").collect()) == [("IS 45", "IS 45:1"), ("is 4", "IS 45:1")]
    n = spark.createDataFrame([(k, 7 * i % 101) for k in "ab" for i in range(100)], "k string, o long")
    assert all(r.pos == sorted(7 * i % 101 for i in range(100)).index(r.o) + 1 for r in standards.numbered(n, "k", "o", width=10).collect())


def test_percentiles_are_exact(spark):
    from lodestone.operators import evaluate

    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=500), "b": np.full(40, 3.0), "c": np.array([5.0]), "d": np.append(np.zeros(300), rng.random(7))}
    d = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, v double")
    for bins in (1024, 3):
        got = {(r.k, r.share): r.value for r in evaluate.percentiles(d, "k", "v", [0.0, 0.5, 0.95, 1.0], bins).collect()}
        assert got == {(k, p): pytest.approx(np.quantile(v, p)) for k, v in values.items() for p in (0.0, 0.5, 0.95, 1.0)}


def test_embedders_and_rerankers(spark):
    from lodestone.operators import embed

    d = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string")
    own = embed.FunctionEmbedder(lambda ts: [[len(t), 1.0] for t in ts], 2)
    assert [r[0] for r in d.orderBy("i").select(embed.embed(F.col("t"), own, batch=1)).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    w = Web(503, ConnectionResetError(), json.dumps({"data": [{"embedding": [1, 2]}]}).encode())
    api = embed.HttpEmbedder("http://x/", "m", 2, query_prefix="query: ", open_=w.open_, sleep=w.sleep)
    assert api.encode(["a"], True).tolist() == [[1.0, 2.0]] and len(w.slept) == 2
    with pytest.raises(ValueError):
        embed.HttpEmbedder("http://x/", "m", 3, open_=Web(json.dumps({"data": [{"embedding": [1, 2]}]}).encode()).open_).encode(["a"], False)
    r = spark.createDataFrame([(1, "q", i, "x" * i, i) for i in range(1, 5)], "qid int, q_text string, doc_id long, text string, rank int")
    got = embed.rerank_with(r, lambda q, ts: [float(-len(t)) for t in ts], head=3)
    assert sorted((x.doc_id, x.rerank) for x in got.collect() if x.rerank is not None) == [(1, -1.0), (2, -2.0), (3, -3.0)] and got.count() == 4


def test_index_is_opened_again_and_verified(spark, tmp_path):
    from lodestone.operators import index

    d = spark.createDataFrame([(i, [f"w{i % 5}", "x"]) for i in range(20)], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["w3"])], "qid long, tokens array<string>")
    a = index.build(d)
    b = index.load(spark, a.where)
    rows = lambda x: sorted(map(tuple, x.probe(q).collect()))
    assert rows(a) == rows(b) and len(rows(a)) == 4
    probes = spark.createDataFrame([(1, ["w3"], 3), (2, ["w3"], 4)], "qid long, tokens array<string>, expected long")
    assert {r.qid: r.found for r in index.verify(a, probes).collect()} == {1: True, 2: False}
    (tmp_path / "vectors.jsonl").write_text('{"id": 1, "embedding": [0.5]}\n')
    assert index.detect(spark, str(tmp_path)) == "json" and index.open_vectors(spark, str(tmp_path)).first().embedding == [0.5]
    with pytest.raises(FileNotFoundError):
        index.detect(spark, str(tmp_path / "none"))


def test_semantic_documents_and_provenance(spark, tmp_path):
    from lodestone.sources import reports

    d = spark.createDataFrame([("IS 1:1990", "D", "C 1", 1990, False, "IS 1:2000"), ("IS 1:2000", "D", "C 1", 2000, True, None)], "designation string, division string, committee string, year int, is_current boolean, superseded_by string")
    reports.write_semantic(str(tmp_path / "s"), d)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["category_hierarchy", "cross_references", "domain_ontology", "search_facets", "temporal_index"]
    read = lambda name: spark.read.json(str(tmp_path / "s" / name))
    assert read("cross_references").where("base is not null").first().chain == ["IS 1:1990 -> IS 1:2000"]
    assert [r.member for r in read("cross_references").where("by = 'latest_editions'").collect()] == ["IS 1:2000"]
    assert {(r.by, r.key, r.n, r.member) for r in read("category_hierarchy").collect()} == {(b, k, 2, m) for b, k in (("division", "D"), ("committee", "C 1")) for m in ("IS 1:1990", "IS 1:2000")}
    assert {(r.by, r.key, r.member) for r in read("temporal_index").where("by <> 'statistics'").collect()} == {("year", "1990", "IS 1:1990"), ("year", "2000", "IS 1:2000"), ("decade", "1990", "IS 1:1990"), ("decade", "2000", "IS 1:2000")}
    assert read("temporal_index").where("by = 'statistics'").first().statistics.total == 2
    reports.write_semantic(str(tmp_path / "t"), d.withColumn("title", F.when(F.col("year") < 2000, "Steel pipes, old").otherwise("Steel tubes of iron")))
    got = spark.read.json(str(tmp_path / "t" / "domain_ontology"))
    assert {(r.key, r.member) for r in got.where("by = 'concept'").collect()} == {("steel", "IS 1:1990"), ("steel", "IS 1:2000")}
    assert got.where("division = 'D'").first().last_year == 2000
    assert reports.provenance(spark, str(tmp_path), 60)["certifiable"] and reports.provenance(spark, str(tmp_path), 9)["suspiciously_small"]
    (tmp_path / "FIXTURE").write_text("made up")
    assert reports.provenance(spark, str(tmp_path), 60)["detail"] == "made up" and not reports.provenance(spark, str(tmp_path), 60)["certifiable"]


def test_stopwatch_adds_up():
    t = iter([0.0, 0.5, 1.0, 1.25])
    watch = windows.Stopwatch(lambda: next(t))
    for _ in range(2):
        with watch("a"):
            pass
    assert watch.ms == {"a": 750.0} and watch.n == {"a": 2}


def test_pdf_text():
    import zlib

    body = b"BT (Hello \\(big\\) standard text) Tj [(of ) -20 (pumps and valves)] TJ ET"
    assert pdf.pdf_text(b"%PDF\nstream\n" + zlib.compress(body) + b"\nendstream") == "Hello (big) standard text of pumps and valves"
    assert pdf.pdf_text(b"") == ""


def test_outputs_and_availability(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"], 'say "x"')], "i int, s array<string>, t string")
    files.write_outputs(d, str(tmp_path))
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first().t == 'say "x"'
    got = {r.name: r.present for r in files.availability(spark, str(tmp_path), ["parquet", "none"]).collect()}
    assert got == {"parquet": True, "none": False}


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    for _ in range(2):  # a second run adds nothing
        windows.ingest(spark.readStream.schema("id long, v string").parquet(src), "id", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_stream_windows_agree_with_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = windows.tumbling(s, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == sorted(map(tuple, windows.tumbling(e, "1 hour").collect()))
    assert windows.sessions(e, "10 minutes").count() > 0


def test_index_scores_are_those_of_the_formulas(spark):
    from lodestone.operators import index

    texts = {i: f"w{i % 7} w{i % 3} common".split() for i in range(30)}
    queries = {1: ["w1", "common"], 2: ["w2", "w2", "none"], 3: ["none"]}
    d = spark.createDataFrame([(i, t, "w1 x" if i % 2 else "y") for i, t in texts.items()], "doc_id long, tokens array<string>, title string")
    q = spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>")
    feats = lambda t: Counter(t + [f"{a}_{b}" for a, b in zip(t, t[1:])])
    df, n = Counter(f for t in texts.values() for f in feats(t)), len(texts)
    avgdl = sum(map(len, texts.values())) / n
    idf = lambda f: math.log(1 + (n - df[f] + 0.5) / (df[f] + 0.5))
    tf_idf = lambda c: {f: x * (math.log((1 + n) / (1 + df[f])) + 1 if df[f] else 1.0) for f, x in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, terms in queries.items():
        qv, keys = tf_idf(feats(terms)), {t for t in terms if len(t) >= 3}
        for i, t in texts.items():
            c, dv = Counter(t), tf_idf(feats(t))
            if not set(terms) & set(t):
                continue
            bm = sum(idf(x) * c[x] * 2.5 / (c[x] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) * (3.0 if i % 2 and x == "w1" else 1.0) for x in terms if c[x])
            part = sum(idf(x) for x in keys & set(t)) / sum(map(idf, keys)) if keys else 0.0
            want[k, i] = pytest.approx((bm, sum(qv[f] * dv[f] for f in qv if f in dv) / length(qv) / length(dv), part))
    own = index.build(d, {"title": 3.0}, per_bucket=20)
    got = {(r.qid, r.doc_id): (r.bm25, r.tfidf, r.coverage) for r in own.probe(q).collect()}
    assert got == want
    assert index.opened(("k",), lambda: own) is index.opened(("k",), lambda: None)


def test_dense_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [0.6, 0.8], True), (3, [0.0, 1.0], True), (4, [1.0, 0.1], False), (5, None, True), (6, [1.0], True), (7, [0.0, 0.0], True)], "vec_id long, embedding array<float>, ok boolean")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [2.0, 0.0]), (10, None)], "qid long, q array<float>")
    got = lambda **o: [(r.qid, r.vec_id, r.score) for r in R.dense(v, q, 2, **o).orderBy("qid", "rank").collect()]
    assert got(where=F.col("ok")) == [(1, 2, 0.6), (1, 3, 0.0), (9, 1, 1.0), (9, 2, 0.6)]
    assert got(where=F.col("ok"), floor=0.7) == [(9, 1, 1.0)]
    assert R.dense(v.limit(0), q, 2).count() == 0 and R.dense(v, q.limit(0), 2).count() == 0


def test_context_is_packed_up_to_the_first_that_overflows(spark):
    rows = [(c, i, 7 * i % 23 + 1) for c in "ab" for i in range(200)]
    d = spark.createDataFrame(rows, "c string, id long, n long")
    want = []
    for c in "ab":
        cum = 0
        for pos, (n, i) in enumerate(sorted((n, i) for k, i, n in rows if k == c), 1):
            cum += n + 2
            if cum > 120:
                break
            want.append((c, i, pos, cum))
    got = R.pack_context(d, "c", ["n", "id"], "n", 120, salts=4).collect()
    assert sorted((r.c, r.id, r.pos, r.cum) for r in got) == sorted(want)


def test_answers_are_checked(spark):
    from lodestone.operators import answers

    r = spark.createDataFrame([(1, 5, "s", 1), (1, 6, "s", 2)], "qid long, doc_id long, source string, pos long")
    a = answers.grounded(r).first()
    assert a.answer == "Found 2 documents: [1] s/5; [2] s/6" and a.grounded and len(a.checked) == 2
    bad = answers.grounded(r, lambda x: answers.extractive(x).withColumn("citations", F.array(F.lit(5).cast("long"), F.lit(7).cast("long")))).first()
    assert not bad.grounded and [(c.cite, c.supported) for c in bad.checked] == [(5, True), (7, False)]


def test_vectors_know_their_maker(spark, tmp_path):
    from lodestone.operators import index

    index.save_vectors(spark.createDataFrame([(1, [0.5])], "id long, embedding array<float>"), str(tmp_path), index.fingerprint("hash", 1))
    assert index.load_vectors(spark, str(tmp_path), index.fingerprint("hash", 1)).count() == 1
    with pytest.raises(index.WrongEmbedder):
        index.load_vectors(spark, str(tmp_path), index.fingerprint("hash", 2))


def test_metrics_gates_and_reports(spark, tmp_path):
    from lodestone.operators import evaluate
    from lodestone.sources import reports

    c = spark.createDataFrame([(True, 1), (True, 2), (True, None), (False, None)], "answerable boolean, rank int")
    m = evaluate.metrics(c)
    got = {r.metric: r.value for r in m.collect()}
    assert got["hit@1"] == 0.25 and got["mrr@5"] == 0.375 and got["coverage"] == 0.75 and got["hit@5_covered"] == pytest.approx(2 / 3)
    assert [r.metric for r in evaluate.gate_failures(m, {"hit@1": (">=", 0.5), "coverage": (">=", 0.5), "none": ("<=", 1)}).collect()] == ["hit@1"]
    assert {r.delta for r in evaluate.compare(m, m).collect()} == {0.0}
    odd = spark.createDataFrame([("<b>|",)], "x string")
    assert "&lt;b&gt;" in reports.render_html({"t": odd}, "a & b") and "a &amp; b" in reports.render_html({}, "a & b")
    assert "\\|" in reports.markdown({"t": odd}, "x")
    reports.write_artifacts(str(tmp_path), m, odd, odd, odd)
    assert spark.read.json(f"{tmp_path}/metrics").count() == m.count()


def test_stream_limiter(spark, tmp_path):
    from lodestone.streaming import limiter as stream

    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(i, "a", t + dt.timedelta(seconds=20 * i)) for i in range(8)], "id long, key string, ts timestamp")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.limit(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), most=2, seconds=60)
    q = s.writeStream.format("memory").queryName("lim").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):  # with time-outs a stream has no end of its own
        got = {r.id: r.accepted for r in spark.sql("SELECT * FROM lim").collect()}
        if len(got) == 8 or not q.isActive:
            break
        time.sleep(1)
    q.stop()
    assert [got[i] for i in range(8)] == [True, True, False, True, True, False, True, True]
