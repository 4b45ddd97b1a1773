"""Text of PDF files without a library: the strings of their content streams."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.designation import find_all
from ..functions.text import collapse

#: Characters below which a text is of no use.
USABLE = 25
_STREAM, _SHOW, _PART = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S), re.compile(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")", re.S), re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def pdf_text(data: bytes) -> str:
    out = []
    for m in _STREAM.finditer(data or b""):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for show in _SHOW.finditer(raw):
            parts = _PART.findall(show.group(1) or show.group(2))
            out.append(b"".join(re.sub(rb"\\(.)", lambda e: _ESCAPE.get(e.group(1), e.group(1)), p, flags=re.S) for p in parts))
    return " ".join(b" ".join(out).decode("latin-1").split())


@F.pandas_udf(T.StringType())
def _texts(data: pd.Series) -> pd.Series:
    return data.map(pdf_text)


def extract(content: Column, most: int | None = None) -> Column:
    """The text of a PDF's bytes, its first `most` characters if that is given; null if there is too little."""
    t = _texts(content) if most is None else F.left(_texts(content), F.lit(most))
    return F.when(F.length(t) >= USABLE, t)


def queries(pdfs: DataFrame, head: int = 2_000) -> DataFrame:
    """(path, q_text, designations) of `pdfs` (path, content): the identifiers that the text names, each once, lead the query, as they
    are exact; then the head of the text. Files without a usable text have no row."""
    t = pdfs.select("path", extract(F.col("content")).alias("t")).where("t is not null").withColumn("designations", find_all(F.col("t")))
    return t.select("path", F.concat_ws(" ", F.array_join("designations", " "), F.left(collapse(F.col("t")), F.lit(head))).alias("q_text"), "designations")
