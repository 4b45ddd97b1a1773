"""Line dedup: windows of three consecutive lines that occur again anywhere later are removed.

Native: DataFrame functions only. Each window is known by two independent 64-bit hashes of its three lines.
The first occurrence in document order (by id, then by text hash, then by line) stays; every later one marks its
three lines, and the marked positions of a document, which overlap, are merged before the lines are cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

#: Tasks over which the occurrences of one window are spread.
SALTS = 16


def _windows(lines: Column, width: int) -> Column:
    """The hashes (a, b) of all windows of `width` lines; none if there are fewer lines."""
    at = lambda i: [F.get(lines, i + j) for j in range(width)]
    starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(*at(i)).alias("a"), F.xxhash64(F.lit("line window"), *at(i)).alias("b")))


def _kept(lines: Column, cut: Column, width: int) -> Column:
    """The lines outside the windows that start at the sorted positions `cut`: the gaps between them, in one pass."""
    n, m = F.size(lines), F.size(cut)
    first = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1) + width)
    until = lambda i: F.when(i == m, n).otherwise(F.get(cut, i))
    gap = lambda i: F.slice(lines, first(i) + 1, F.greatest(F.lit(0), until(i) - first(i)))
    return F.flatten(F.transform(F.sequence(F.lit(0), m), gap))


def mark(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `r` (the row), `lines`, `cut` (sorted starts of the windows to remove, null if none), `kept`."""
    text = F.coalesce(F.col(f"r.`{text_col}`"), F.lit(""))
    rows = packed(docs).withColumn("lines", F.split(text, "\n", -1))
    rows = rows.withColumn("doc", F.coalesce(F.col(f"r.`{id_col}`").cast("long"), F.lit(-(2**63)))).withColumn("key", F.xxhash64(text))
    found = rows.select("doc", "key", F.posexplode(_windows(F.col("lines"), width)).alias("pos", "w")).select("doc", "key", "pos", "w.a", "w.b")
    found = found.distinct() if _repeats(docs, id_col) else found
    place = F.struct("doc", "key", "pos")
    again = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = again.select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    later = found.withColumn("s", F.pmod(F.xxhash64("doc", "key", "pos"), F.lit(SALTS)).cast("int")).join(again, ["a", "b", "s"])
    later = later.where(place > F.col("first"))
    cuts = later.groupBy("doc", "key").agg(F.array_sort(F.collect_set("pos")).alias("cut"))
    rows = rows.join(cuts, ["doc", "key"], "left")
    return rows.withColumn("kept", F.when(F.col("cut").isNull(), F.col("lines")).otherwise(_kept(F.col("lines"), F.col("cut"), width)))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether any id comes twice; only then must repeated rows be folded before windows are counted."""
    return docs.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").limit(1).count() > 0


def dedup_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later occurrences of line windows cut from their texts; all columns and rows stay.

    Lines are split at newlines and compared byte for byte, empty ones too. A null text stays null, a text of fewer than
    `width` lines is never changed, a text that loses all lines becomes empty. Repeated rows (same id, same text) count as
    one document, so they are all treated alike. n_chars, if there, is brought up to date.
    """
    done = mark(docs, width, id_col, text_col)
    text = F.when(F.col("cut").isNull(), F.col(f"r.`{text_col}`")).otherwise(F.array_join("kept", "\n"))
    done = done.select("r", "cut", text.alias("new_text"))
    out = [F.col("new_text").alias(c) if c == text_col else F.when(F.col("cut").isNull(), F.col("r.n_chars")).otherwise(F.length("new_text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"r.`{c}`").alias(c) for c in docs.columns]
    return done.select(*out)


def report(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_md5 of each document."""
    text = F.array_join("kept", "\n")
    done = mark(docs, width)
    return done.select(F.col("r.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), text.alias("x")).select("doc_id", "n_lines", "n_removed", F.length("x").cast("long").alias("kept_chars"), F.md5(F.col("x").cast("binary")).alias("kept_md5"))
