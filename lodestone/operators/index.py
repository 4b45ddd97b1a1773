"""Persisted indexes: postings with document statistics and block maxima, and vectors with the fingerprint of what made them."""

from __future__ import annotations

import atexit
import hashlib
import math
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import B, K1, top

#: Postings in a bucket, on average; features of queries that one broadcast carries at most.
BUCKET_ROWS, FEATURE_BLOCK = 2_000_000, 500_000
#: Documents of a block; the terms, by falling frequency, whose statistics a build broadcasts.
BLOCK_DOCS, FREQUENT = 16, 50_000
#: Slots that a scan names one by one, so that other buckets aren't read: so many at most, and so many for each bucket, as with
#: more nearly all buckets are read anyway.
NAMED_SLOTS, SLOTS_A_BUCKET = 20_000, 3
#: Scores are compared after rounding to six places: what a bound may lack.
SLACK = 2e-6


class WrongEmbedder(ValueError):
    """The vectors were made by another embedder than the one that asks."""


def fingerprint(name: str, dim: int, version: str = "1") -> str:
    """What tells one embedder from another: sixteen hex digits."""
    return hashlib.sha256(f"{name}/{dim}/{version}".encode()).hexdigest()[:16]


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder last changed and how large it is, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir; where all runs on this machine, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"/tmp/lodestone-index/{spark.sparkContext.applicationId}"
    return f"{where.rstrip('/')}/index-{uuid.uuid4().hex}"


@dataclass
class Index:
    """Terms of a corpus: tokenised and weighed once, probed by any number of queries.

    Tables below `where`: `docs` (the rows with `tokens`, `dl`: their number, `block`, and `tf_len`: the length of the TF-IDF
    vector), `vocab` (f, df, idf, tf_idf, shards; f is a term, or two neighbours joined by `_`), `stats` (n, avgdl), and the
    bucketed postings of single terms and of neighbours, `words` and `pairs`.

    A row of postings is a block: what one term has in up to 16 documents that stand together in the order of the fields, so
    that they score alike. It holds `hits` (doc_id, tf, bm: the BM25 part of one query term, tv: the TF-IDF weight over the
    vector's length) and the largest `bm` and `tv` of them, with the documents they stand in. Blocks are bucketed by `slot`: the term, and for frequent terms
    one of several shards, so that a probe reads the buckets of its terms only and no bucket grows with a single term.
    """

    spark: SparkSession
    where: str
    table: str
    buckets: int = 0

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/{name}")

    @property
    def docs(self) -> DataFrame:
        return self.read("docs")

    @property
    def vocab(self) -> DataFrame:
        return self.read("vocab")

    @property
    def stats(self) -> DataFrame:
        """One row."""
        return self.read("stats")

    def blocks(self, pairs: bool = True) -> DataFrame:
        words = self.spark.table(f"{self.table}_words")
        return words.unionByName(self.spark.table(f"{self.table}_pairs")) if pairs else words

    def features(self, queries: DataFrame, few: bool = False) -> DataFrame:
        """(qid, f, qn, qw, part, shards) of queries (qid, tokens): how often a query has a term, nothing for two neighbours; its
        TF-IDF weight over the vector's length, where terms that no document has count with an idf of 1; and, of terms of three
        letters at least, the share of all of them by idf. shards is null for terms that no document has.
        `few`: the terms fit a broadcast."""
        own = queries.select("qid", F.explode(F.concat(F.transform("tokens", lambda t: F.struct(t.alias("f"), F.lit(1).alias("one"))), F.transform(X.bigrams(F.col("tokens")), lambda t: F.struct(t.alias("f"), F.lit(0).alias("one"))))).alias("x")).select("qid", "x.*")
        own = own.groupBy("qid", "f").agg(F.sum("one").alias("qn"), F.count("*").alias("tf"))
        unseen = F.log(1 + (F.col("n") + 0.5) / 0.5)
        known = self.vocab.select("f", "idf", "tf_idf", "shards")
        known = F.broadcast(known.join(F.broadcast(own.select("f")), "f", "left_semi")) if few else known
        w = own.join(known, "f", "left").join(F.broadcast(self.stats)).withColumn("w", F.col("tf") * F.coalesce("tf_idf", F.lit(1.0)))
        w = w.withColumn("key", F.when((F.col("qn") > 0) & (F.length("f") >= 3), F.coalesce("idf", unseen)).otherwise(0.0))
        lens = w.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.sum("key").alias("keys"))
        return w.join(lens, "qid").select("qid", "f", "qn", (F.col("w") / F.col("len")).alias("qw"), F.when(F.col("keys") > 0, F.col("key") / F.col("keys")).otherwise(0.0).alias("part"), "shards")

    def ask(self, queries: DataFrame) -> list[pa.Table]:
        """The features of queries (qid, tokens) as local rows with `slot`, in parts of a checked size: what `search` starts from, for
        several searches of the same queries."""
        most = queries.agg(F.sum(F.size("tokens") * 2)).first()[0] or 0  # no fewer than there are features
        parts, out = max(1, math.ceil(most / FEATURE_BLOCK)), []
        for i in range(parts):
            own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
            f = self.features(own, True).where("shards is not null")
            out.append(f.withColumn("slot", F.explode(_slots(F.col("f"), F.col("shards")))).drop("shards").toArrow())  # FEATURE_BLOCK rows, and shards
        return out

    def _asked(self, queries: DataFrame | list[pa.Table], pairs: bool) -> list[tuple[DataFrame, DataFrame]]:
        """Features as frames, each with the blocks of its buckets."""
        out = []
        for rows in queries if isinstance(queries, list) else self.ask(queries):
            rows = rows if pairs else rows.filter(pc.greater(rows.column("qn"), 0))
            names = pc.unique(rows.column("slot")).to_pylist()
            blocks = self.blocks(pairs)
            few = len(names) <= min(NAMED_SLOTS, SLOTS_A_BUCKET * self.buckets)
            out.append((self.spark.createDataFrame(rows), blocks.where(F.col("slot").isin(names)) if few else blocks))
        return out

    def probe(self, queries: DataFrame) -> DataFrame:
        """(qid, doc_id, bm25, tfidf, coverage) of all documents that share a term with a query: both scores, and the share of the
        query's terms, by idf, that the document has."""
        out = None
        for f, blocks in self._asked(queries, True):
            got = _scored(blocks.join(F.broadcast(f), "slot"))
            out = got if out is None else out.union(got)
        return out

    def search(self, queries: DataFrame | list[pa.Table], k: int, by: str = "bm25", floor: float | None = None) -> DataFrame:
        """(qid, doc_id, score, coverage, rank): the k best of `probe` by "bm25" or "tfidf", of those above `floor`.

        Blocks are bounded before they are opened: a document of a block scores at most the sum of its terms' largest values
        there. And a document in which some of these values stand scores at least their sum; the k-th best of such sums is
        what a block's bound must reach. Both read a few columns; hits are opened once, of the blocks that are left. BM25
        reads single terms only. `queries`: a frame (qid, tokens), or what `ask` made of one.
        """
        weight, most, best = {"bm25": ("qn", "bm_max", "bm_doc"), "tfidf": ("qw", "tv_max", "tv_doc")}[by]
        out = None
        for f, blocks in self._asked(queries, by == "tfidf"):
            asked = F.broadcast(f)
            parts = blocks.select("slot", "block", most, F.col(best).alias("best")).join(asked.select("slot", "qid", weight), "slot")
            parts = _checkpoint(parts.groupBy("qid", "block", "best").agg(F.sum(F.col(weight) * F.col(most)).alias("score")))
            least = top(parts.withColumn("doc_id", F.col("best")), k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
            bound = parts.groupBy("qid", "block").agg(F.sum("score").alias("bound")).join(least, "qid", "left")
            left = bound.where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
            left = (left if floor is None else left.where(F.col("bound") > floor - SLACK)).select("qid", "block")
            if parts.count() <= FEATURE_BLOCK:  # no fewer than blocks
                got = blocks.join(asked, "slot").join(F.broadcast(left), ["qid", "block"], "left_semi")
            else:  # no hits move for a query
                pairs = blocks.select("slot", "block").join(asked, "slot").join(left, ["qid", "block"], "left_semi")
                got = blocks.select("slot", "block", "hits").join(pairs, ["slot", "block"])
            got = _scored(got).withColumn("score", F.col(by)).where(F.col("score").isNotNull() & (F.lit(True) if floor is None else F.round("score", 6) > floor))
            got = top(got, k).select("qid", "doc_id", "score", "coverage", "rank")
            out = got if out is None else out.union(got)
        return out

    def files_read(self, queries: DataFrame, by: str = "bm25") -> tuple[int, int]:
        """How many files of postings a search opens, of how many there are."""
        pairs = by == "tfidf"
        plans = [blocks for _, blocks in self._asked(queries, pairs)]
        return len({x for p in plans for x in _files(p)}), len(self.blocks().inputFiles())

    def drop(self) -> None:
        """Remove the tables and the folder."""
        for kind in ("words", "pairs"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}_{kind}")
        _remove(self.spark, self.where)
        for key in [key for key, me in _open.items() if me is self]:
            del _open[key]


def _files(df: DataFrame) -> list[str]:
    """The files that the scans of a plan read, after pruning of buckets."""
    plan, out = df._jdf.queryExecution().sparkPlan(), []

    def walk(node) -> None:
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            rdd = node.inputRDD()
            for i in range(rdd.getNumPartitions()):
                files = rdd.partitions()[i].files()
                out.extend(files[j].filePath().toString() for j in range(len(files)))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return out


def _largest(name: str) -> list[Column]:
    """The largest value of the hits and the document it is in, the first of several."""
    one = F.array_max(F.transform("hits", lambda h: F.struct(h[name].alias("v"), (-h["doc_id"]).alias("d"))))
    return [one["v"].alias(f"{name}_max"), (-one["d"]).alias(f"{name}_doc")]


def _checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that what is used twice is worked out once."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession).rpartition("/")[0])
    return df.checkpoint()


def _slots(f: Column, shards: Column) -> Column:
    return F.when(shards == 1, F.array(f)).otherwise(F.transform(F.sequence(F.lit(0), shards - 1), lambda i: F.concat_ws("#", f, i.cast("string"))))


def _scored(joined: DataFrame) -> DataFrame:
    each = joined.select("qid", "qn", "qw", "part", F.explode("hits").alias("h")).select("qid", "qn", "qw", "part", "h.*")
    return each.groupBy("qid", "doc_id").agg(F.sum(F.when(F.col("qn") > 0, F.col("qn") * F.col("bm"))).alias("bm25"), F.sum(F.col("qw") * F.col("tv")).alias("tfidf"), F.sum("part").alias("coverage"))


def count_terms(docs: DataFrame, where: str, fields: dict[str, float] = {}) -> tuple[DataFrame, DataFrame]:
    """Write and return what weighing starts from: `tokens`, the rows with `dl`, and `counts` (doc_id, f, tf, one, dl, boost)."""
    spark = docs.sparkSession
    # by document, so that counting a document's terms moves nothing
    docs.repartition("doc_id").withColumn("dl", F.size("tokens")).write.mode("overwrite").parquet(f"{where}/tokens")
    tokens = spark.read.parquet(f"{where}/tokens")
    boost = F.lit(1.0)
    for f, by in fields.items():
        boost = boost * F.when(F.array_contains(F.split(F.lower(f), "[^a-z0-9]+"), F.col("f")), by).otherwise(1.0)
    both = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("f"), F.lit(True).alias("one"))), F.transform(X.bigrams(F.col("tokens")), lambda t: F.struct(t.alias("f"), F.lit(False).alias("one"))))
    each = tokens.repartition("doc_id").select("doc_id", "dl", *fields, F.explode(both).alias("x")).select("doc_id", "dl", *fields, "x.*")
    counts = each.groupBy("doc_id", "f").agg(F.count("*").alias("tf"), F.first("one").alias("one"), F.first("dl").alias("dl"), F.first(boost).alias("boost"))
    counts.write.mode("overwrite").parquet(f"{where}/counts")
    return tokens, spark.read.parquet(f"{where}/counts")


def weigh(tokens: DataFrame, counts: DataFrame, where: str, order: list[str] = [], per_bucket: int = BUCKET_ROWS, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of counted documents. `order`: columns by which documents stand in blocks, before their id."""
    spark = tokens.sparkSession
    me = Index(spark, where, f"lodestone_{uuid.uuid4().hex}")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{where}/{name}")
    put(tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")), "stats")
    n = F.broadcast(me.stats)  # one row
    by = [*order, "doc_id"]
    at = F.col("at")
    placed = tokens.select(*by).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    put(placed.select("doc_id", (F.shiftleft(F.shiftright(at, 33), 33) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / block_docs)).alias("block")), "placed")
    vocab = counts.groupBy("f").agg(F.count("*").alias("df"), F.first("one").alias("one")).join(n)
    shards = F.ceil(F.col("df") / max(1, per_bucket // 4)).cast("int")
    put(vocab.select("f", "one", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("tf_idf"), shards.alias("shards")), "vocab")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("boost")
    terms = me.vocab.select("f", "idf", "tf_idf", "shards")
    often = F.broadcast(me.vocab.orderBy(F.desc("df"), "f").limit(FREQUENT).select("f", "idf", "tf_idf", "shards"))
    known = counts.join(often, "f").unionByName(counts.join(often.select("f"), "f", "left_anti").join(terms, "f"))
    put(known.join(n).select("doc_id", "f", "one", "shards", "tf", F.when(F.col("one"), part).alias("bm"), (F.col("tf") * F.col("tf_idf")).alias("w")), "weighed")
    weighed = me.read("weighed")
    lens = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tf_len"))
    put(tokens.join(lens, "doc_id", "left").join(me.read("placed"), "doc_id"), "docs")
    slot = F.when(F.col("shards") == 1, F.col("f")).otherwise(F.concat_ws("#", "f", F.pmod(F.xxhash64("block"), F.col("shards")).cast("string")))
    final = weighed.join(me.docs.select("doc_id", "block", "tf_len"), "doc_id").select("one", slot.alias("slot"), "f", "block", F.struct("doc_id", "tf", "bm", (F.col("w") / F.col("tf_len")).alias("tv")).alias("h"))
    sizes = {r["one"]: r["n"] for r in weighed.groupBy("one").agg(F.count("*").alias("n")).collect()}
    made = {}
    for kind, one in (("words", True), ("pairs", False)):
        made[kind] = max(spark.sparkContext.defaultParallelism, math.ceil(sizes.get(one, 0) / per_bucket))
        rows = final.where(F.col("one") == one).repartition(made[kind], "slot").groupBy("slot", "f", "block").agg(F.array_sort(F.collect_list("h")).alias("hits"))
        rows = rows.select("slot", "f", "block", *_largest("bm"), *_largest("tv"), "hits")
        rows.write.option("path", f"{where}/{kind}").bucketBy(made[kind], "slot").sortBy("slot", "block").saveAsTable(f"{me.table}_{kind}")
    me.buckets = sum(made.values())
    spark.createDataFrame([(made["words"], made["pairs"])], "words int, pairs int").coalesce(1).write.mode("overwrite").json(f"{where}/meta")
    for name in ("weighed", "placed"):
        _remove(spark, f"{where}/{name}")
    return me


def build(docs: DataFrame, fields: dict[str, float] = {}, per_bucket: int = BUCKET_ROWS, block_docs: int = BLOCK_DOCS) -> Index:
    """Index `docs` (doc_id, tokens, fields and any other columns). A term that is a word of one of `fields` is boosted in BM25.
    The index lasts until `drop`, or until the driver's Python ends."""
    spark = docs.sparkSession
    where = shared_folder(spark)
    tokens, counts = count_terms(docs, where, fields)
    me = weigh(tokens, counts, where, list(fields), per_bucket, block_docs)
    for name in ("tokens", "counts"):
        _remove(spark, f"{where}/{name}")
    atexit.register(_leave, me)
    return me


def keep(me: Index) -> None:
    """Leave an index in its folder when this application ends, for `load`."""
    _kept.add(me.where)


_kept: set[str] = set()


def _leave(me: Index) -> None:
    """At the end of the driver's Python, when Spark may be gone already."""
    if me.where not in _kept and me.spark.sparkContext._jsc is not None:
        try:
            _remove(me.spark, me.where)
        except Exception:  # noqa: BLE001 - the store or the JVM may be gone by then
            pass


def _remove(spark: SparkSession, where: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, where: str) -> Index:
    """An index that was built before, by this application or another."""
    buckets = spark.read.schema("words int, pairs int").json(f"{where}/meta").first()
    me = Index(spark, where, f"lodestone_{uuid.uuid4().hex}", sum(buckets))
    for kind in ("words", "pairs"):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{where}/{kind}").schema.fields)
        spark.sql(f"CREATE TABLE {me.table}_{kind} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot, block) INTO {int(buckets[kind])} BUCKETS LOCATION '{where}/{kind}'")
    return me


def verify(me: Index, probes: DataFrame, k: int = 5) -> DataFrame:
    """(qid, expected, rank, found) of probes (qid, tokens, expected: a document id) after a build: where each is among its best k."""
    best = me.search(probes.select("qid", "tokens"), k)
    hit = best.select("qid", F.col("doc_id").alias("expected"), "rank")
    return probes.select("qid", "expected").join(hit, ["qid", "expected"], "left").withColumn("found", F.col("rank").isNotNull())


_open: dict[tuple, Index] = {}


def opened(key: tuple, make) -> Index:
    """The index that this application has built under a key, or the one that `make` builds now."""
    if key not in _open:
        _open[key] = make()
    return _open[key]


def save_vectors(rows: DataFrame, where: str, made_by: str) -> None:
    """(id, embedding, metadata...) with the maker's fingerprint beside it."""
    rows.write.mode("overwrite").parquet(f"{where}/vectors")
    rows.sparkSession.createDataFrame([(made_by,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{where}/meta")


def load_vectors(spark: SparkSession, where: str, made_by: str) -> DataFrame:
    have = spark.read.schema("fingerprint string").json(f"{where}/meta").first()["fingerprint"]
    if have != made_by:
        raise WrongEmbedder(f"vectors of {have}, wanted {made_by}")
    return spark.read.parquet(f"{where}/vectors")


#: What tells a backend of stored vectors: the entry of its folder that only it has, and how it is read.
BACKENDS = {
    "parquet": ("vectors", lambda spark, where: spark.read.parquet(f"{where}/vectors")),
    "json": ("vectors.jsonl", lambda spark, where: spark.read.schema("id long, embedding array<double>").json(f"{where}/vectors.jsonl")),
}


def detect(spark: SparkSession, where: str, backends: dict = BACKENDS) -> str:
    """The name of the backend whose entry is in the folder; the first of several."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, (entry, _) in backends.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{where}/{entry}")
        if p.getFileSystem(conf).exists(p):
            return name
    raise FileNotFoundError(f"{where}: no vectors of {', '.join(backends)}")


def open_vectors(spark: SparkSession, where: str, backends: dict = BACKENDS) -> DataFrame:
    return backends[detect(spark, where, backends)][1](spark, where)
