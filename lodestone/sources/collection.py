"""A searchable collection as a Spark data source, for batches and streams, and resumable downloads of its files.

The listing behind it is the paginated one of `rest`: a query `q`, pages by start and rows, documents as JSON. Here documents have
typed columns, filters go into the query, and a stream goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from .rest import RETRY, Client, delay

#: Bytes written at a time.
CHUNK = 1 << 20
#: What a column may be, and how a value of the listing becomes one; of a list the first value counts.
KINDS = {StringType(): str, IntegerType(): int, LongType(): int, DoubleType(): float, BooleanType(): lambda v: v if isinstance(v, bool) else str(v).lower() in ("true", "1", "yes")}


class Collection(D.DataSource):
    """format("collection"): options url, columns (DDL: strings, numbers, booleans), q (a query that always holds), rows (page size),
    sort, and timeout, tries, interval of the client. Only the columns that are declared are asked for.

    With the option push, filters on columns are sent with the query where the listing can answer them, and Spark applies the
    others; Spark asks for spark.sql.python.filterPushdown.enabled to be set then. A value that isn't of its column's type is null. Sort by something to which new documents are
    added at the end, as a stream takes those beyond the place where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return (_Pushing if self.options.get("push", "false").lower() == "true" else _Batch)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> D.DataSourceStreamReader:
        return _Stream(dict(self.options), schema)


class _Pages:
    """Pages of a query."""

    def __init__(self, options: dict, schema: StructType):
        self.o, self.columns = options, [(f.name, KINDS.get(f.dataType)) for f in schema.fields]
        odd = [n for n, kind in self.columns if kind is None]
        if odd:
            raise ValueError(f"columns of another kind: {', '.join(odd)}")
        self.asked = [self.o["q"]] if self.o.get("q") else []

    def page(self, start: int, rows: int) -> dict:
        fixed = {"q": " AND ".join(f"({x})" for x in self.asked) or "*:*", "fl": ",".join(n for n, _ in self.columns)} | ({"sort": self.o["sort"]} if self.o.get("sort") else {})
        client = Client(tries=int(self.o.get("tries", 4)), timeout=float(self.o.get("timeout", 30)), interval=float(self.o.get("interval", 0)))
        return json.loads(client.get(self.o["url"], {**fixed, "start": start, "rows": rows}))["response"]

    def found(self) -> int:
        return int(self.page(0, 0)["numFound"])

    def cut(self, low: int, high: int) -> list[D.InputPartition]:
        size = int(self.o.get("rows", 100))
        return [D.InputPartition((i, min(size, high - i))) for i in range(low, high, size)]

    def rows_of(self, partition: D.InputPartition) -> Iterator[tuple]:
        start, n = partition.value
        for doc in self.page(start, n)["docs"]:
            yield tuple(_value(doc.get(name), kind) for name, kind in self.columns)


def _value(v, kind):
    v = (v[0] if v else None) if isinstance(v, list) else v
    try:
        return None if v is None else kind(v)
    except (TypeError, ValueError):
        return None


class _Batch(_Pages, D.DataSourceReader):
    def partitions(self) -> list[D.InputPartition]:
        return self.cut(0, self.found())

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        return self.rows_of(partition)


class _Pushing(_Batch):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            term = query_of(f, dict(self.columns))
            if term is None:
                yield f
            else:
                self.asked.append(term)


class _Stream(_Pages, D.DataSourceStreamReader):
    """Offsets are numbers of documents, so a batch that runs again asks for the same pages. Nothing is to be forgotten on commit."""

    def initialOffset(self) -> dict:
        return {"start": 0}

    def latestOffset(self) -> dict:
        return {"start": self.found()}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        return self.cut(int(start["start"]), int(end["start"]))

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        return self.rows_of(partition)

    def commit(self, end: dict) -> None:
        pass


def _literal(v) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        escaped = v.replace("\\", "\\\\").replace('"', '\\"')
        return f'"{escaped}"'
    return None


def query_of(f: D.Filter, kinds: dict) -> str | None:
    """A filter as a term of the query, or None if the listing can't answer it just as Spark would. Ranges of texts are left to
    Spark, whose order of letters may be another."""
    if isinstance(f, D.Not):
        inner = query_of(f.child, kinds)
        # a document without the field fails NOT (field = value) in SQL, but not in the listing
        field = getattr(f.child, "attribute", (None,))
        return None if inner is None or len(field) != 1 or isinstance(f.child, (D.IsNull, D.IsNotNull)) else f"(NOT {inner} AND {field[0]}:*)"
    field = getattr(f, "attribute", None)
    if field is None or len(field) != 1 or field[0] not in kinds:
        return None
    name, number = field[0], kinds[field[0]] in (int, float)
    if isinstance(f, D.IsNotNull):
        return f"{name}:*"
    if isinstance(f, D.In):
        each = [_literal(v) for v in f.value]
        return None if not each or None in each else f"{name}:({' OR '.join(each)})"
    v = _literal(getattr(f, "value", None))
    if v is None:
        return None
    if isinstance(f, D.EqualTo):
        return f"{name}:{v}"
    if number:
        for kind, shape in ((D.GreaterThanOrEqual, "[{} TO *]"), (D.GreaterThan, "{{{} TO *]"), (D.LessThanOrEqual, "[* TO {}]"), (D.LessThan, "[* TO {}}}")):
            if isinstance(f, kind):
                return f"{name}:{shape.format(v)}"
    return None


def found(queries: DataFrame, url: str, client: Client | None = None) -> DataFrame:
    """(q, found, error): how many documents of the collection each distinct query of `queries` (q) has, asked in the tasks and without
    fetching any. Where the listing doesn't answer, `found` is null and the error says why."""
    client = client or Client()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column(0).to_pylist():
                n, error = None, None
                try:
                    n = int(json.loads(client.get(url, {"q": q, "start": 0, "rows": 0}))["response"]["numFound"])
                except (OSError, ValueError, KeyError, TypeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([n], pa.int64()), pa.array([error], pa.string())], names=["q", "found", "error"])

    return queries.select(F.col("q").cast("string").alias("q")).where("q is not null").distinct().mapInArrow(run, "q string, found long, error string")


# --------------------------------------------------------------------------- files
def fetch(client: Client, url: str, path: str, md5: str | None = None) -> tuple[str, int]:
    """Download to `path` and return (how, bytes that came now): `kept` if it is there with the right checksum, `resumed` or `whole`.

    What has come goes to `path`.part and is asked for no more: the next try goes on with Range. A server that sends the whole
    again (200) starts it anew, and so does one that knows no more bytes (416) if the checksum is wrong. A file takes its name
    when it is whole; one whose checksum stays wrong after a whole download raises ValueError and leaves no part.
    """
    if os.path.exists(path) and (md5 is None or _md5(path) == md5):
        return "kept", 0
    part, came, how = f"{path}.part", 0, "whole"
    for attempt in range(client.tries):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        headers = {"User-Agent": client.agent, **({"Range": f"bytes={have}-"} if have else {})}
        try:
            with client.open_(urllib.request.Request(url, headers=headers), timeout=client.timeout) as r:
                on = bool(have) and getattr(r, "status", 200) == 206
                how = "resumed" if on else "whole"
                with open(part, "ab" if on else "wb") as out:
                    while block := r.read(CHUNK):
                        out.write(block)
                        came += len(block)
        except urllib.error.HTTPError as e:
            if e.code == 416 and have:
                how = "resumed"  # there is no more: what is here is checked below
            elif e.code not in RETRY or attempt == client.tries - 1:
                raise
            else:
                client.sleep(delay(attempt, after=e.headers.get("Retry-After") if e.headers else None))
                continue
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == client.tries - 1:
                raise
            client.sleep(delay(attempt))
            continue
        if md5 is None or _md5(part) == md5:
            os.replace(part, path)
            return how, came
        os.remove(part)
        if how == "whole":
            raise ValueError(f"{url}: the checksum is not {md5}")
    raise ValueError(f"{url}: the checksum is not {md5}")


def _md5(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def download(files: DataFrame, folder: str, client: Client | None = None) -> DataFrame:
    """(name, how, bytes, error) of each row of `files` (name, url, md5): downloaded in the tasks to `folder`, a path that is mounted on
    all machines, so that another machine can go on with a part. `how` is null where it failed. A null md5 isn't checked; names
    with folders in them, or none, fail. Rows of one name go to one task; of several the smallest URL is taken."""
    client = client or Client()
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, url, md5 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                how, came, error = None, 0, None
                try:
                    if not name or os.path.basename(name) != name or name in (".", ".."):
                        raise ValueError("no plain file name")
                    how, came = fetch(client, url, os.path.join(folder, name), md5)
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([how], pa.string()), pa.array([came], pa.int64()), pa.array([error], pa.string())], names=["name", "how", "bytes", "error"])

    one = files.groupBy("name").agg(F.min(F.struct("url", "md5")).alias("x")).select("name", "x.url", "x.md5")
    return one.mapInArrow(run, "name string, how string, bytes long, error string")
