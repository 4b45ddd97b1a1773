"""Files in and out: line-delimited JSON with exact errors, evaluation cases, documents, availability, outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import values as V


class BadRecord(ValueError):
    """A line that can't be read."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; fields outside the schema are dropped. Blank lines and values that aren't objects are skipped; a
    broken line is an error that names its file and line. Lines are counted only then, in that file alone."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    parsed = lines.select("value", "_file", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    objects = F.trim("value").startswith("{")
    bad = parsed.where(objects & F.col("r._bad").isNotNull()).select("_file", "value").limit(1).collect()
    if bad:
        file, value = bad[0]
        whole = spark.read.text(file, wholetext=True)
        each = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("i", "v")).where(F.col("v") == value)
        n = each.agg(F.min("i")).first()[0]
        raise BadRecord(f"{file}:{'?' if n is None else n + 1}: {value[:200]}")
    return parsed.where(objects).select("r.*").drop("_bad")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents: an object, or an array of objects, in each file; fields outside the schema are dropped."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a heading, columns by their name; a blank field, or one that says NaN, is null."""
    names = StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    has = lambda n: F.nullif(F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")), F.lit("NaN")) if n in raw.columns else F.lit(None)
    return raw.select(*[has(f.name).try_cast(f.dataType).alias(f.name) for f in names.fields])


def read_chunks(spark: SparkSession, path: str, schema: str, text: str = "chunk", least: float = 0.9, shortest: int = 40) -> DataFrame:
    """Passages of at least `shortest` characters; an error if less than `least` of the rows have any text."""
    rows = read_jsonl(spark, path, schema)
    n, full = rows.agg(F.count("*"), F.count(V.first_present(F.col(text)))).first()
    if n and full / n < least:
        raise BadRecord(f"{path}: {full} of {n} rows have {text}")
    return rows.where(F.length(text) >= shortest)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: JSON lines with `#` comments; repeated ids and empty queries are errors."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    c = lines.select(F.from_json("value", "id string, query string, expected array<string>, difficulty string, sector string, tags array<string>, rationale string").alias("r")).select("r.*")
    if c.groupBy("id").count().where("count > 1").limit(1).count():
        raise BadRecord(f"{path}: repeated id")
    if c.where(F.coalesce(F.trim("query"), F.lit("")) == "").limit(1).count():
        raise BadRecord(f"{path}: empty query")
    return c


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, designations): product phrases and their aliases in lower case; the last entry of a phrase wins."""
    raw = spark.read.option("multiLine", True).schema("products array<struct<phrase:string,designations:array<string>,aliases:array<string>>>").json(path)
    p = raw.select(F.posexplode("products").alias("i", "p")).select("i", F.explode(F.concat(F.array("p.phrase"), F.coalesce("p.aliases", F.array().cast("array<string>")))).alias("phrase"), "p.designations")
    return p.groupBy(F.lower("phrase").alias("phrase")).agg(F.max_by("designations", "i").alias("designations"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(identifier, text) of the text files in a folder."""
    t = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("f"), "value")
    return t.select(F.regexp_extract("f", r"([^/]+?)(?:_djvu)?\.txt$", 1).alias("identifier"), F.col("value").alias("text"))


def verify(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(name, md5, ok): files of a folder against their expected md5 sums."""
    got = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("got"))
    return wanted.join(got, "name", "left").select("name", "md5", (F.coalesce("got", F.lit("")) == F.col("md5")).alias("ok"))


def availability(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(name, present, bytes) of datasets below a root, whatever store it is in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        fs = p.getFileSystem(conf)
        there = fs.exists(p)
        rows.append((n, there, fs.getContentSummary(p).getLength() if there else 0))
    return spark.createDataFrame(rows, "name string, present boolean, bytes long")


def write_outputs(rows: DataFrame, out: str) -> None:
    """A merged dataset as Parquet, JSON lines, JSON arrays (one in each file) and quoted CSV."""
    rows.write.mode("overwrite").parquet(f"{out}/parquet")
    rows.write.mode("overwrite").json(f"{out}/jsonl")
    write_json_arrays(rows, f"{out}/json")
    write_csv(rows, f"{out}/csv")


def write_json_arrays(rows: DataFrame, out: str) -> None:
    """Each partition as one JSON array: rows are streamed between brackets, so that any JSON reader takes a file whole. A frame
    without partitions writes no array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *("," + x for x in lines[1:])])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(out)


def write_csv(rows: DataFrame, out: str, where: Column | None = None, columns: list[str] | None = None) -> None:
    """Rows, filtered if asked for, as CSV with a heading, every field quoted, quotes doubled; arrays are joined by `; `. The export of
    a filtered listing and of a checklist."""
    kept = rows.where(where) if where is not None else rows
    kept = kept.select(*columns) if columns else kept
    flat = kept.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in kept.dtypes])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(out)


def write_split(rows: DataFrame, flag: str, out: str) -> None:
    """Held and missing rows in folders of their own, in one pass."""
    rows.write.mode("overwrite").partitionBy(flag).option("header", True).csv(out)
