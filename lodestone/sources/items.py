"""Nested item records: files, loosely typed metadata, descriptions of labelled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "metadata struct<identifier:string,title:string,date:string,creator:string,description:string,licenseurl:string,`access-restricted-item`:string>, files array<struct<name:string,format:string,size:string,md5:string,private:string>>"


def best_file(files: Column, formats: list[str]) -> Column:
    """The name of the first public file of the most preferred format, or null."""
    public = F.filter(files, lambda f: ~F.coalesce(f["private"].cast("boolean"), F.lit(False)))
    rank = F.array(*[F.lit(x) for x in formats])
    found = F.filter(public, lambda f: F.array_contains(rank, f["format"]))
    return F.get(F.array_sort(F.transform(found, lambda f, i: F.struct(F.array_position(rank, f["format"]).alias("p"), i.alias("i"), f["name"].alias("name")))), F.lit(0))["name"]


def is_restricted(files: Column, flag: Column | None = None) -> Column:
    """The flag says so, or there are files and none is public."""
    none_public = (F.size(files) > 0) & ~F.exists(files, lambda f: ~F.coalesce(f["private"].cast("boolean"), F.lit(False)))
    return none_public if flag is None else F.coalesce(F.lower(flag) == "true", F.lit(False)) | none_public


def labelled(description: Column, labels: list[str]) -> Column:
    """A map of the labels' values in a run-on text: a value ends where the next label starts."""
    ends = "|".join(rf"{x}\s*:" for x in labels)
    pairs = [v for x in labels for v in (F.lit(x), F.nullif(F.trim(F.regexp_extract(description, rf"(?is){x}\s*:\s*(.*?)(?=\s*(?:{ends})|$)", 1)), F.lit("")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def parse_items(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """identifier, title, date, files, text_file, pdf_file, restricted of JSON items; values that are lists are joined by `; `."""
    text = lambda k: F.coalesce(
        F.array_join(F.from_json(F.get_json_object(json_col, f"$.metadata.{k}"), "array<string>"), "; "),
        F.get_json_object(json_col, f"$.metadata.{k}"),
    )
    files = F.from_json(F.get_json_object(json_col, "$.files"), "array<struct<name:string,format:string,size:string,md5:string,private:string>>")
    r = raw.select(*[text(k).alias(k) for k in ("identifier", "title", "date", "description")], F.coalesce(files, F.from_json(F.lit("[]"), "array<struct<name:string,format:string,size:string,md5:string,private:string>>")).alias("files"), F.get_json_object(json_col, "$.metadata['access-restricted-item']").alias("flag"))
    return r.withColumn("text_file", best_file(F.col("files"), ["DjVuTXT", "Text"])).withColumn("pdf_file", best_file(F.col("files"), ["Text PDF", "PDF"])).withColumn("restricted", is_restricted(F.col("files"), F.col("flag"))).drop("flag")
