"""An index that grows: immutable segments, deletions, a refresh that weighs what is live, and compaction.

A segment holds the counted terms of one batch of documents, or ids that are deleted. The segment that was added last has the
say about an id, so an update is a segment with the id again. Nothing is ever changed in place: a manifest, one small file for
each version, names the segments, and the next version is written under a name that only one writer can take. A batch that is
added twice under one source counts once. Statistics (document frequencies, lengths) are those of the last `refresh`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .index import BUCKET_ROWS, Index, _remove, count_terms, load, weigh


class Conflict(RuntimeError):
    """Another writer has made the next version first; what this one wrote is gone, and it may try again."""


@dataclass
class Store:
    """An index's segments below `where`, a folder that driver and executors share. `fields`: as in `index.build`, fixed for good."""

    spark: SparkSession
    where: str
    fields: dict[str, float]

    # ------------------------------------------------------------------ versions
    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}" if name else self.where)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest version: its number, segments in the order in which they were added, and the name of the index if there is one."""
        fs, folder = self._fs(), self._path("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "next": 0, "segments": [], "index": None}
        stream = fs.open(self._path(f"manifests/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, old: dict, **changes) -> dict:
        """Make the version after `old`; Conflict if it is there already."""
        new = {**old, **changes, "version": old["version"] + 1}
        jvm, fs = self.spark._jvm, self._fs()
        part, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{new['version']:09d}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # without leave to overwrite, so that one of two writers fails
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(final), plain)
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {new['version']} is there already") from None
            raise
        return new

    # ------------------------------------------------------------------ changes
    def _add(self, write: Callable[[str], object], kind: str, source: str | None) -> None:
        if _known(self.manifest(), source):
            return
        name = uuid.uuid4().hex
        write(f"{self.where}/segments/{name}")
        while True:
            m = self.manifest()
            if _known(m, source):
                break  # the same batch, by another attempt
            try:
                self._commit(m, next=m["next"] + 1, segments=[*m["segments"], {"name": name, "order": m["next"], "kind": kind, "source": source}])
                return
            except Conflict:
                continue
        _remove(self.spark, f"{self.where}/segments/{name}")

    def add(self, docs: DataFrame, source: str | None = None) -> None:
        """Add or update `docs` (doc_id, tokens, fields and others, always the same columns; ids distinct within a batch)."""
        self._add(lambda where: count_terms(docs, where, self.fields), "docs", source)

    def delete(self, ids: DataFrame, source: str | None = None) -> None:
        """Delete documents by `doc_id`; ids that aren't there do no harm."""
        self._add(lambda where: ids.select("doc_id").distinct().write.parquet(f"{where}/dead"), "dead", source)

    def feed(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add every micro-batch of a stream of documents; one that runs again after a failure counts once. Of the rows of an id within
        a batch one is taken."""
        name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: self.add(df.dropDuplicates(["doc_id"]), f"{name}/{i}")).start()

    # ------------------------------------------------------------------ reading
    def live(self, m: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(tokens, counts) of the documents that are neither deleted nor replaced by a later segment."""
        m = m or self.manifest()
        read = self.spark.read.parquet
        ids, tokens, counts = None, None, None
        both = lambda a, b: b if a is None else a.unionByName(b)
        for s in m["segments"]:
            at, where = F.lit(s["order"]).alias("_order"), f"{self.where}/segments/{s['name']}"
            dead = s["kind"] == "dead"
            part = read(f"{where}/{'dead' if dead else 'tokens'}")
            ids = both(ids, part.select("doc_id", at))
            if not dead:
                tokens, counts = both(tokens, part.select("*", at)), both(counts, read(f"{where}/counts").select("*", at))
        if tokens is None:
            raise ValueError("the store has no documents")
        if len(m["segments"]) > 1:
            # few ids change hands, so it is those that are taken out
            last = ids.groupBy("doc_id").agg(F.max("_order").alias("last"), F.count("*").alias("n")).where("n > 1")
            stale = ids.join(last, "doc_id").where(F.col("_order") < F.col("last")).select("doc_id", "_order")
            tokens, counts = (x.join(stale, ["doc_id", "_order"], "left_anti") for x in (tokens, counts))
        return tokens.drop("_order"), counts.drop("_order")

    def refresh(self, per_bucket: int = BUCKET_ROWS) -> Index:
        """Weigh all live documents and make that the store's index; it equals one built of them at once. The index before it stays for
        those who read it, until `vacuum`."""
        m = self.manifest()
        tokens, counts = self.live(m)
        name = uuid.uuid4().hex
        me = weigh(tokens, counts, f"{self.where}/indexes/{name}", list(self.fields), per_bucket)
        while True:
            now = self.manifest()
            try:
                self._commit(now, index=name, of=m["version"])
                break
            except Conflict:
                continue
        return me

    def index(self) -> Index:
        """The index of the last refresh."""
        name = self.manifest()["index"]
        if name is None:
            raise ValueError("refresh the store first")
        return load(self.spark, f"{self.where}/indexes/{name}")

    def compact(self) -> None:
        """Put all live documents into one segment. What was added meanwhile stays as it is; if segments that this one has read were
        compacted meanwhile, Conflict. Tasks that run twice write into a folder that only the new manifest names; the old segments
        stay for those who read them, until `vacuum`."""
        m = self.manifest()
        tokens, counts = self.live(m)
        name, old = uuid.uuid4().hex, [s["name"] for s in m["segments"]]
        for kind, df in (("tokens", tokens), ("counts", counts)):
            df.write.parquet(f"{self.where}/segments/{name}/{kind}")
        while True:
            now = self.manifest()
            if [s["name"] for s in now["segments"][: len(old)]] != old:
                _remove(self.spark, f"{self.where}/segments/{name}")
                raise Conflict("another compaction came first")
            # sources stay known, so that an old batch can't come again
            one = {"name": name, "order": m["segments"][-1]["order"], "kind": "docs", "source": None}
            done = [*now.get("done", []), *(s["source"] for s in m["segments"] if s["source"])]
            try:
                self._commit(now, segments=[one, *now["segments"][len(old) :]], done=done)
                break
            except Conflict:
                continue

    def vacuum(self, seconds: float = 86_400) -> int:
        """Remove segments and indexes that the newest version doesn't name and that are older than a reader or writer may take; how
        many were removed."""
        m, fs, removed = self.manifest(), self._fs(), 0
        now = time.time() * 1000
        for folder, named in (("segments", {s["name"] for s in m["segments"]}), ("indexes", {m["index"]})):
            for s in fs.listStatus(self._path(folder)) if fs.exists(self._path(folder)) else []:
                if s.getPath().getName() not in named and s.getModificationTime() <= now - 1000 * seconds:
                    fs.delete(s.getPath(), True)
                    removed += 1
        return removed


def _known(m: dict, source: str | None) -> bool:
    return source is not None and (source in m.get("done", []) or any(s["source"] == source for s in m["segments"]))


def open_store(spark: SparkSession, where: str, fields: dict[str, float] | None = None) -> Store:
    """A store that is there, or a new one with `fields`."""
    me = Store(spark, where.rstrip("/"), fields or {})
    m = me.manifest()
    if m["version"] == 0:
        me._commit(m, fields=me.fields)
    else:
        me.fields = m["fields"]
    return me
