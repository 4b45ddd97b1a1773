"""A collection read in batches and streams with its filters pushed, and downloads that go on where they stopped."""

import hashlib
import http.server
import json
import re
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lodestone.sources import collection
from lodestone.sources.rest import Client


class Server:
    """A listing of documents and files on this machine; it keeps what it was asked."""

    def __init__(self):
        self.docs = [{"identifier": f"d{i}", "year": 1990 + i, "title": ["first", "other"] if i % 2 else "even"} for i in range(25)]
        self.docs[3] |= {"year": "unknown"}
        del self.docs[4]["title"]
        self.files, self.ranges, self.asked, self.break_after, self.whole = {}, [], [], None, False
        me = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                path, _, query = self.path.partition("?")
                if path == "/search":
                    return me.search(self, {k: v[0] for k, v in urllib.parse.parse_qs(query).items()})
                return me.file(self, path.strip("/"))

            def log_message(self, *a):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def search(self, h, q):
        self.asked.append(q)
        rows = self.docs
        low = re.search(r"year:\[(\d+) TO \*\]", q["q"])
        rows = [d for d in rows if not low or isinstance(d["year"], int) and d["year"] >= int(low[1])]
        at, n = int(q["start"]), int(q["rows"])
        body = json.dumps({"response": {"numFound": len(rows), "docs": rows[at : at + n]}}).encode()
        h.send_response(200)
        h.end_headers()
        h.wfile.write(body)

    def file(self, h, name):
        data, asked = self.files.get(name), h.headers.get("Range")
        self.ranges.append(asked)
        if data is None:
            h.send_error(404)
            return
        start = int(asked[6:-1]) if asked and not self.whole else 0
        if asked and not self.whole and start >= len(data):
            h.send_error(416)
            return
        h.send_response(206 if start else 200)
        h.send_header("Content-Length", str(len(data) - start))
        h.end_headers()
        stop = len(data) if self.break_after is None else start + self.break_after
        h.wfile.write(data[start:stop])  # a short answer breaks the connection


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def source(spark, server, kind="read"):
    spark.dataSource.register(collection.Collection)
    return getattr(spark, kind).format("collection").option("url", f"{server.url}/search").option("columns", "identifier string, year int, title string").option("rows", 10).option("sort", "addeddate asc")


def test_batch_reads_typed_columns(spark, server):
    got = {r.identifier: (r.year, r.title) for r in source(spark, server).load().collect()}
    assert len(got) == 25 and got["d3"] == (None, "first") and got["d4"] == (1994, None) and got["d5"] == (1995, "first")
    assert {q["fl"] for q in server.asked} == {"identifier,year,title"} and {q["sort"] for q in server.asked} == {"addeddate asc"}
    with pytest.raises(Exception, match="another kind"):
        source(spark, server).option("columns", "x array<int>").load().collect()


def test_filters_reach_the_listing_and_others_stay(spark, server):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = source(spark, server).option("push", "true").option("q", "collection:standards").load().where((F.col("year") >= 2010) & F.col("title").like("%ve%") & (F.length("identifier") == 3))
        got = sorted(r.identifier for r in df.collect())
        assert got == ["d20", "d22", "d24"]
        pages = [q for q in server.asked if q["rows"] != "0"]
        assert pages and all("year:[2010 TO *]" in q["q"] and "(collection:standards)" in q["q"] for q in server.asked)
        assert sum(int(q["rows"]) for q in pages) == 5  # of 25
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "length(identifier" in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_terms_of_filters():
    from pyspark.sql import datasource as D

    kinds = {"a": str, "n": int, "b": bool}
    q = lambda f: collection.query_of(f, kinds)
    assert q(D.EqualTo(("a",), 'x"y')) == 'a:"x\\"y"' and q(D.EqualTo(("b",), True)) == "b:true"
    assert q(D.In(("n",), (1, 2))) == "n:(1 OR 2)" and q(D.In(("n",), (1, None))) is None
    assert q(D.GreaterThan(("n",), 5)) == "n:{5 TO *]" and q(D.LessThan(("n",), 5)) == "n:[* TO 5}" and q(D.LessThanOrEqual(("n",), 5)) == "n:[* TO 5]"
    assert q(D.GreaterThan(("a",), "x")) is None and q(D.EqualTo(("z",), 1)) is None and q(D.EqualTo(("a", "b"), 1)) is None
    assert q(D.Not(D.EqualTo(("a",), "x"))) == '(NOT a:"x" AND a:*)' and q(D.IsNotNull(("n",))) == "n:*"
    assert q(D.IsNull(("n",))) is None and q(D.StringContains(("a",), "x")) is None


def test_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        source(spark, server, "readStream").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.identifier for r in spark.read.parquet(out).collect())

    assert len(run()) == 25
    server.docs += [{"identifier": f"n{i}", "year": 2020, "title": "new"} for i in range(13)]
    server.asked.clear()
    assert run() == sorted(d["identifier"] for d in server.docs)  # none lost, none twice
    assert min(int(q["start"]) for q in server.asked if q["rows"] != "0") == 25
    assert len(run()) == 38


def test_sizes_of_queries(spark, server):
    q = spark.createDataFrame([("*:*",), ("year:[2010 TO *]",), ("*:*",), (None,)], "q string")
    assert {(r.q, r.found, r.error) for r in collection.found(q, f"{server.url}/search").collect()} == {("*:*", 25, None), ("year:[2010 TO *]", 5, None)}
    assert "404" in collection.found(q.limit(1), f"{server.url}/nowhere", Client(tries=1)).first().error


# ------------------------------------------------------------------ downloads
DATA = bytes(range(256)) * 5_000
MD5 = hashlib.md5(DATA).hexdigest()


def client(tries=1):
    return Client(tries=tries, sleep=lambda s: None)


def test_download_resumes(server, tmp_path):
    server.files["f"], path = DATA, tmp_path / "f"
    (tmp_path / "f.part").write_bytes(DATA[:1_000_000])
    assert collection.fetch(client(), f"{server.url}/f", str(path), MD5) == ("resumed", len(DATA) - 1_000_000)
    assert path.read_bytes() == DATA and server.ranges == ["bytes=1000000-"] and not (tmp_path / "f.part").exists()
    assert collection.fetch(client(), f"{server.url}/f", str(path), MD5) == ("kept", 0) and len(server.ranges) == 1


def test_download_of_servers_without_ranges_and_whole_parts(server, tmp_path):
    server.files["f"], server.whole = DATA, True
    (tmp_path / "f.part").write_bytes(b"old" * 9)
    assert collection.fetch(client(), f"{server.url}/f", str(tmp_path / "f"), MD5) == ("whole", len(DATA))
    server.whole = False
    (tmp_path / "g.part").write_bytes(DATA)  # it was whole already: 416
    server.files["g"] = DATA
    assert collection.fetch(client(), f"{server.url}/g", str(tmp_path / "g"), MD5) == ("resumed", 0)
    (tmp_path / "h.part").write_bytes(DATA + b"too much")
    server.files["h"] = DATA
    assert collection.fetch(client(2), f"{server.url}/h", str(tmp_path / "h"), MD5) == ("whole", len(DATA))


def test_download_with_a_wrong_checksum_leaves_nothing(server, tmp_path):
    server.files["f"] = b"something else"
    with pytest.raises(ValueError, match="checksum"):
        collection.fetch(client(3), f"{server.url}/f", str(tmp_path / "f"), MD5)
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "f.part").write_bytes(b"some")  # a part of another file: taken anew once
    server.files["f"] = DATA
    assert collection.fetch(client(2), f"{server.url}/f", str(tmp_path / "f"), MD5)[0] == "whole"


def test_downloads_of_a_frame(spark, server, tmp_path):
    server.files |= {f"x{i}": f"body {i}".encode() * 1_000 for i in range(6)}
    rows = [(n, f"{server.url}/{n}", hashlib.md5(b).hexdigest()) for n, b in server.files.items()] + [("gone", f"{server.url}/gone", None), ("../up", f"{server.url}/x1", None), (None, f"{server.url}/x1", None), ("x0", f"{server.url}/x0", hashlib.md5(server.files["x0"]).hexdigest())]
    files = spark.createDataFrame(rows, "name string, url string, md5 string")
    got = {r.name: r for r in collection.download(files, str(tmp_path / "out"), client()).collect()}
    assert {n for n, r in got.items() if r.how == "whole"} == {f"x{i}" for i in range(6)}
    assert "404" in got["gone"].error and got["../up"].how is None and got[None].how is None
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"x{i}" for i in range(6))
