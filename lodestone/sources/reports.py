"""Reports for people: evaluation artifacts and a standalone page of gaps. Both are of bounded size and made on the driver."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import standards as S

#: Rows that a report shows at most; how many there are is said in it.
ROWS = 1_000


def _cell(v) -> str:
    return "" if v is None else html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))


def render_html(tables: dict[str, DataFrame], title: str) -> str:
    """A page with a table for each frame, everything escaped."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows, n = df.limit(ROWS).collect(), df.count()
        parts.append(f"<h2>{html.escape(name)} ({n})</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows]
        parts.append("</table>")
    return "".join(parts) + "</body></html>"


def markdown(tables: dict[str, DataFrame], title: str) -> str:
    out = [f"# {title}"]
    for name, df in tables.items():
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(_cell(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(ROWS).collect()]
    return "\n".join(out) + "\n"


def write_artifacts(out: str, metrics: DataFrame, failures: DataFrame, missing: DataFrame, ablation: DataFrame | None = None) -> None:
    """metrics as JSON, failures as JSON lines, missing documents as JSON, the ablation as CSV; whole tables, in Spark's writers."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{out}/metrics")
    failures.write.mode("overwrite").json(f"{out}/failures")
    missing.write.mode("overwrite").json(f"{out}/missing")
    if ablation is not None:
        ablation.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/ablation")


def provenance(spark: SparkSession, root: str, documents: int, marker: str = "FIXTURE", least: int = 50) -> dict:
    """Where data come from: whether a marker file says that they are made up (and what it says), whether there are suspiciously few
    documents, and so whether figures on them may be certified."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{marker}")
    made_up = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    detail = "\n".join(r[0] for r in spark.read.text(f"{root}/{marker}").limit(ROWS).collect()) if made_up else ""
    small = 0 < documents < least
    return {"fixture": made_up, "detail": detail, "documents": documents, "suspiciously_small": small, "certifiable": not made_up and documents >= least}


def members(rows: DataFrame, groups: dict[str, Column], name: str = "designation") -> DataFrame:
    """(by, key, n, member): a line for each member of each group, with the group's size. Rows without a key are in no group."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("by"), c.cast("string").alias("key")) for k, c in groups.items()]))
    long = rows.select(each.alias("g"), F.col(name).alias("member")).select("g.*", "member").where("key is not null and key <> ''").distinct()
    return long.join(long.groupBy("by", "key").agg(F.count("*").alias("n")), ["by", "key"]).select("by", "key", "n", "member")


def write_semantic(out: str, rows: DataFrame, shortest: int = 5) -> None:
    """Five JSON documents over `rows` (designation, division, committee, year, is_current, superseded_by, and title if there is one):
    category_hierarchy and temporal_index with the members of their groups, cross_references, domain_ontology (years and
    committees of each division; concepts: title words of `shortest` letters at least that several titles hold, with their
    members), search_facets. A line for each group and member, never a whole index in one row."""
    each = lambda k: rows.groupBy(F.col(k).alias("key")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).withColumn("by", F.lit(k))
    put = lambda df, name: df.write.mode("overwrite").json(f"{out}/{name}")
    put(members(rows, {"division": F.col("division"), "committee": F.col("committee")}), "category_hierarchy")
    latest = members(rows.where("is_current"), {"latest_editions": F.lit("all")})
    put(S.chains(rows).unionByName(latest, allowMissingColumns=True), "cross_references")
    domains = rows.groupBy("division").agg(F.count("*").alias("n"), F.countDistinct("committee").alias("committees"), F.sum(F.col("is_current").cast("long")).alias("current"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    if "title" in rows.columns:
        words = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= shortest))
        held = rows.select("designation", F.explode(words).alias("word"))
        domains = domains.unionByName(members(held, {"concept": F.col("word")}).where("n > 1"), allowMissingColumns=True)
    put(domains, "domain_ontology")
    decade = (F.floor(F.col("year") / 10) * 10).cast("long")
    when = members(rows, {"year": F.col("year"), "decade": decade})
    put(when.unionByName(S.temporal_statistics(rows).select(F.lit("statistics").alias("by"), F.struct("*").alias("statistics")), allowMissingColumns=True), "temporal_index")
    put(each("division").unionByName(each("committee")), "search_facets")


def health(available: DataFrame, standards: DataFrame, least: int = 50) -> DataFrame:
    """One row: datasets present and missing, documents, and whether figures on them may be certified (enough documents)."""
    a = available.agg(F.sum(F.col("present").cast("long")).alias("present"), F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("name")))).alias("missing"))
    return a.join(F.broadcast(standards.agg(F.count("*").alias("documents")))).withColumn("certifiable", (F.col("documents") >= least) & (F.size("missing") == 0))
