"""A paginated listing as a Spark data source, one partition per page, with retries, and tables of HTML pages."""

from __future__ import annotations

import hashlib
import html as markup
import json
import os
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses worth another try.
RETRY = (408, 425, 429, 500, 502, 503, 504)


def delay(attempt: int, base: float = 1.0, most: float = 60.0, after: str | None = None, jitter: float = 0.25) -> float:
    """Seconds before another try: what Retry-After asks for, else doubling up to `most`, with jitter."""
    try:
        if after is not None and float(after) >= 0:
            return min(most, float(after))
    except ValueError:
        pass
    return min(most, base * 2**attempt) * (1 + random.uniform(-jitter, jitter))


@dataclass
class Client:
    """GET with retries, polite spacing and revalidation. What it opens, sleeps and tells time with can be replaced in tests.

    Worth another try: the statuses of RETRY, refused and reset connections, timeouts. `interval`: seconds between two requests
    of this client at least. `cache`: a folder where bodies with an entity tag are kept, to be asked for by If-None-Match.
    """

    tries: int = 4
    timeout: float = 30.0
    interval: float = 0.0
    cache: str | None = None
    agent: str = "lodestone/1"
    open_: Callable = urllib.request.urlopen
    sleep: Callable = time.sleep
    clock: Callable = time.monotonic
    last: float = field(default=float("-inf"), init=False)

    def get(self, url: str, params: dict | None = None, headers: dict | None = None) -> bytes:
        """The body; urllib's errors where nothing helps."""
        kept = self._kept(url, params)
        tag = self._read(f"{kept}.tag") if kept else None
        body = self._read(f"{kept}.body") if tag is not None else None
        full = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}" if params else url
        asked = {"User-Agent": self.agent, **(headers or {}), **({"If-None-Match": tag.decode()} if body is not None else {})}
        for attempt in range(self.tries):
            wait = self.last + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last, after = self.clock(), None
            try:
                with self.open_(urllib.request.Request(full, headers=asked), timeout=self.timeout) as r:
                    got, new = r.read(), r.headers.get("ETag") if r.headers else None
                if kept and new:  # the tag last: a body without one is never used
                    self._write(f"{kept}.body", got)
                    self._write(f"{kept}.tag", new.encode())
                return got
            except urllib.error.HTTPError as e:
                if e.code == 304 and body is not None:
                    return body
                if e.code not in RETRY or attempt == self.tries - 1:
                    raise
                after = e.headers.get("Retry-After") if e.headers else None
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.tries - 1:
                    raise
            self.sleep(delay(attempt, after=after))
        raise AssertionError("no try left")

    def _kept(self, url: str, params: dict | None) -> str | None:
        """Where a URL with its parameters is kept."""
        if self.cache is None:
            return None
        os.makedirs(self.cache, exist_ok=True)
        return os.path.join(self.cache, hashlib.sha1((url + json.dumps(params or {}, sort_keys=True)).encode()).hexdigest())

    @staticmethod
    def _read(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    @staticmethod
    def _write(path: str, data: bytes) -> None:
        part = f"{path}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)


def read_urls(urls: DataFrame, client: Client | None = None, skip: tuple[int, ...] = (401, 403)) -> DataFrame:
    """(url, status, body, error) of each row of `urls` (url): fetched in the tasks, so partitions of `urls` set how many at once. A
    page that can't be had doesn't stop the others: its error is in its row; one of the statuses in `skip` is no error."""
    client = client or Client()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                status, body, error = 200, None, None
                try:
                    body = client.get(url)
                except urllib.error.HTTPError as e:
                    status, error = e.code, None if e.code in skip else f"{e.code} {e.reason}"
                except (OSError, ValueError) as e:
                    status, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([status], pa.int32()), pa.array([body], pa.binary()), pa.array([error], pa.string())], names=["url", "status", "body", "error"])

    return urls.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "url string, status int, body binary, error string")


def extract_pages(pages: DataFrame, extract: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of any page extractor: a function from a body to dictionaries, run over `pages` (url, body). Rows keep their url; a page
    without a body has none."""
    fields = StructType.fromDDL(f"url string, {schema}")
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [{"url": url, **r} for r in extract(body)] if body is not None else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    return pages.select("url", "body").mapInArrow(run, fields)


class Listing(DataSource):
    """format("listing"): options url, rows (page size), total or max_items, fields (those asked for, by commas), sort, and timeout,
    tries, interval of the client. Rows are (offset, value): each document as JSON. Pages are told apart by offsets, so sort by
    something that doesn't change."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def _page(self, start: int, rows: int) -> dict:
        asked = {"start": start, "rows": rows} | {name: self.o[k] for k, name in (("fields", "fl"), ("sort", "sort")) if self.o.get(k)}
        client = Client(tries=int(self.o.get("tries", 4)), timeout=float(self.o.get("timeout", 30)), interval=float(self.o.get("interval", 0)))
        return json.loads(client.get(self.o["url"], asked))["response"]

    def partitions(self) -> list[InputPartition]:
        size = int(self.o.get("rows", 100))
        total = int(self.o["total"]) if "total" in self.o else int(self._page(0, 0)["numFound"])
        return [InputPartition(i) for i in range(0, min(total, int(self.o.get("max_items", total))), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        size, most = int(self.o.get("rows", 100)), int(self.o.get("max_items", 1 << 62))
        for i, doc in enumerate(self._page(partition.value, size)["docs"]):
            if partition.value + i < most:
                yield partition.value + i, json.dumps(doc)


def pages_of(dumps: DataFrame) -> DataFrame:
    """The documents of recorded pages (column value: the JSON of each)."""
    docs = F.from_json(F.get_json_object("value", "$.response.docs"), "array<string>")
    return dumps.select(F.explode(docs).alias("value"))


_ROW, _CELL, _TAG = re.compile(r"(?is)<tr\b.*?</tr>"), re.compile(r"(?is)<t([hd])\b[^>]*>(.*?)</t\1>"), re.compile(r"<[^>]+>")


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, row, header, cells) of all table rows of HTML pages; entities resolved, tags cut, white space collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, row in enumerate(_ROW.findall(text or "")):
                    cells = _CELL.findall(row)
                    if cells:
                        out.append((page, i, all(k.lower() == "h" for k, _ in cells), [" ".join(markup.unescape(_TAG.sub(" ", c)).split()) for _, c in cells]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string())), strict=True)], names=["page", "row", "header", "cells"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "page long, row int, header boolean, cells array<string>")


#: Headings of columns that hold identifiers, and beginnings of those that never do.
ID_HEADINGS, OTHER_HEADINGS = ("is number", "is", "standard", "is no."), ("sl. no", "sl no", "s. no", "s.no", "product category", "notification", "product", "remarks")


def infer_column(headers: Column) -> Column:
    """The place, from 0, of the column that holds identifiers: the first whose heading says so, else the first heading that isn't
    known to be of another kind; null if there is none."""
    low = F.transform(headers, lambda h: F.lower(F.coalesce(h, F.lit(""))))
    names = F.transform(low, lambda h: h.contains("is no") | F.trim(h).isin(*ID_HEADINGS) | (F.array_contains(F.split(F.trim(h), r"\s+"), "is") & F.array_contains(F.split(F.trim(h), r"\s+"), "no")))
    other = F.transform(low, lambda h: (h != "") & ~h.rlike("^(" + "|".join(re.escape(x) for x in OTHER_HEADINGS) + ")"))
    return F.nullif(F.coalesce(F.nullif(F.array_position(names, True), F.lit(0)), F.array_position(other, True)), F.lit(0)) - 1


def table_items(pages: DataFrame, wanted: str = r"(?i)\bIS\s*:?\s*\d+") -> DataFrame:
    """(page, row, spelling, context): of each table row the cell that holds an identifier, and its longest other cell that isn't a number."""
    hit = lambda c: c.rlike(wanted)
    r = table_rows(pages).where("not header").withColumn("at", F.array_position(F.transform("cells", hit), True)).where("at > 0")
    others = F.filter("cells", lambda c, i: (i + 1 != F.col("at")) & ~c.rlike(r"^[\d\s.]*$"))
    best = F.array_min(F.transform(others, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))))
    return r.select("page", "row", F.get("cells", (F.col("at") - 1).cast("int")).alias("spelling"), F.coalesce(best["c"], F.lit("")).alias("context"))
