"""Identifiers of versioned documents: prefix, number, part, section, year, reaffirmation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The accepted spellings of an identifier.
YEAR = r"(?:18|19|20)\d{2}"
DASH = r"\-.–"
#: Groups: 1 prefix, 2 number chain, 3 keyword, 4 part, 5 section, 6 year in parentheses, 7-9 the same without parentheses,
#: 10 year after a separator, 11 bare year, 12 reaffirmed.
_HEAD = rf"\b(IS/IEC|IS/ISO|IS|SP)\s*:?\s*(\d+(?:\s*[{DASH}]\s*\d+)*)"
_PART = rf"(?:\s*\(\s*(Part|Sec(?:tion)?\.?)\s*(\d+)(?:\s*/\s*Sec(?:tion)?\.?\s*(\d+))?\s*\)|\s*\(\s*({YEAR})\s*\)|\s+(Part|Sec(?:tion)?\.?)\s*(\d+)(?:\s*/\s*Sec(?:tion)?\.?\s*(\d+))?)?"
_TAIL = rf"(?:\s*[:{DASH}]\s*({YEAR})|\s+({YEAR})(?![\d.]))?(?:\s*\(\s*Reaffirm(?:ed|ation)?\.?\s*({YEAR})\s*\))?"
FULL = rf"(?i){_HEAD}{_PART}{_TAIL}\s*$"
SCAN = rf"(?i){_HEAD}{_PART}{_TAIL}(?!\s*\d)(?!\s*(?:part|sec(?:tion)?|reaffirm(?:ed|ation)?|:|-)\b)"

#: Groups of FULL.
GROUPS = 12
#: The plain spelling that pages are scraped for.
SCRAPE = r"\bIS\s+(\d{1,5})(?:\s*\(Part\s*\d+\))?:(\d{4})"

STRUCT = T.StructType([T.StructField("prefix", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("number", "part", "section", "year", "reaffirmed")])


def parse(c: Column) -> Column:
    """The identifier that a whole text is, as a struct; null where it is none or contradicts itself.

    A chain `302-2-15` is number, part and section. A two-link chain ending like a year is a number and its year, unless a part
    is named or another year is there. Two readings of one field that differ give null.
    """
    mark = "\u0001"
    # one run of the pattern: what stands before it, its groups, and what stands after
    cut = F.split(F.regexp_replace(c, FULL, mark + mark.join(f"${g}" for g in range(1, GROUPS + 1)) + mark), mark)
    return F.get(F.transform(F.array(cut), _made), F.lit(0))


def _made(cut: Column) -> Column:
    """The struct of a text that is cut at its groups."""
    got = lambda g: F.nullif(F.get(cut, F.lit(g)), F.lit(""))
    whole = (F.size(cut) == GROUPS + 2) & (F.trim(F.get(cut, F.lit(0))) == "")
    chain = F.transform(F.split(got(2), rf"\s*[{DASH}]\s*"), lambda x: x.try_cast("int"))
    number, cp, cs = F.get(chain, F.lit(0)), F.get(chain, F.lit(1)), F.get(chain, F.lit(2))
    keyword, first, second = F.lower(F.coalesce(got(3), got(7))), F.coalesce(got(4), got(8)).try_cast("int"), F.coalesce(got(5), got(9)).try_cast("int")
    is_section = F.coalesce(keyword.startswith("sec"), F.lit(False))
    part, section = F.when(~is_section, first), F.when(is_section, first).otherwise(second)
    paren, sep = got(6).try_cast("int"), F.coalesce(got(10), got(11)).try_cast("int")
    year = F.coalesce(sep, paren)
    yearlike = cp.cast("string").rlike(f"^{YEAR}$") & cs.isNull()
    takes_year = part.isNull() & section.isNull() & cp.isNotNull() & yearlike
    bad = (
        (sep.isNotNull() & paren.isNotNull())
        | (part.isNull() & section.isNotNull() & cp.isNotNull() & cs.isNotNull())
        | (takes_year & year.isNotNull())
        | (part.isNotNull() & cp.isNotNull() & (part != cp))
        | (section.isNotNull() & cs.isNotNull() & (section != cs))
        | (F.size(chain) > 3)
    )
    made = F.struct(
        F.upper(got(1)).alias("prefix"),
        number.alias("number"),
        F.coalesce(part, F.when(~takes_year, cp)).alias("part"),
        F.coalesce(section, cs).alias("section"),
        F.coalesce(year, F.when(takes_year, cp)).alias("year"),
        got(12).try_cast("int").alias("reaffirmed"),
    )
    return F.when(whole & number.isNotNull() & ~F.coalesce(bad, F.lit(False)), made)


def canonical(d: Column) -> Column:
    """The join key: six fields, `None` for missing ones."""
    return F.concat_ws("|", *[F.coalesce(d[n].cast("string"), F.lit("None")) for n in ("prefix", "number", "part", "section", "year", "reaffirmed")])


def key_without_year(d: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(d[n].cast("string"), F.lit("None")) for n in ("prefix", "number", "part", "section")])


def render(d: Column) -> Column:
    """The usual spelling."""
    p, s = d["part"].cast("string"), d["section"].cast("string")
    middle = (
        F.when(p.isNotNull() & s.isNotNull(), F.concat(F.lit(" (Part "), p, F.lit(" / Section "), s, F.lit(")")))
        .when(p.isNotNull(), F.concat(F.lit(" (Part "), p, F.lit(")")))
        .when(s.isNotNull(), F.concat(F.lit(" (Section "), s, F.lit(")")))
        .otherwise(F.lit(""))
    )
    year = F.coalesce(F.concat(F.lit(":"), d["year"].cast("string")), F.lit(""))
    again = F.coalesce(F.concat(F.lit(" (Reaffirmed "), d["reaffirmed"].cast("string"), F.lit(")")), F.lit(""))
    return F.when(d["number"].isNotNull(), F.concat(d["prefix"], F.lit(" "), d["number"].cast("string"), middle, year, again))


def yearless(c: Column) -> Column:
    """`is 302 (part 2)` from a canonical key, a spelling, or any text."""
    parts = F.split(c, r"\|")
    field = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("None")).try_cast("int")
    none = F.lit(None).cast("int")
    of_key = F.struct(F.get(parts, F.lit(0)).alias("prefix"), field(1).alias("number"), field(2).alias("part"), field(3).alias("section"), none.alias("year"), none.alias("reaffirmed"))
    # bound by a lambda, so that a text is parsed once and not for each field of each spelling
    bare = lambda d: F.struct(d["prefix"].alias("prefix"), d["number"].alias("number"), d["part"].alias("part"), d["section"].alias("section"), none.alias("year"), none.alias("reaffirmed"))
    of_text = F.get(F.transform(F.transform(F.array(parse(c)), bare), render), F.lit(0))
    plain = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(c.contains("|"), F.lower(render(of_key))).otherwise(F.coalesce(F.lower(of_text), plain))


def of_identifier(c: Column, start: str = "gov.in.is.") -> Column:
    """The identifier in dotted digits after a fixed start, as a struct; a last link like a year is the year if another is left."""
    body = F.filter(F.split(F.substring(c, len(start) + 1, 1_000_000), r"\."), lambda x: x != "")
    digits = (F.size(body) > 0) & F.forall(body, lambda x: x.rlike(r"^\d+$")) & F.lower(c).startswith(start)
    numbers = F.transform(body, lambda x: x.try_cast("int"))
    has_year = (F.size(body) >= 2) & F.element_at(body, -1).rlike(f"^{YEAR}$")
    rest = F.when(has_year, F.slice(numbers, 1, F.size(numbers) - 1)).otherwise(numbers)
    made = F.struct(F.lit("IS").alias("prefix"), F.get(rest, F.lit(0)).alias("number"), F.get(rest, F.lit(1)).alias("part"), F.get(rest, F.lit(2)).alias("section"), F.when(has_year, F.get(numbers, F.size(numbers) - 1)).alias("year"), F.lit(None).cast("int").alias("reaffirmed"))
    return F.when(digits, made)


def find_all(c: Column) -> Column:
    """All identifiers in a text, in order, each once; those that contradict themselves are left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SCAN), F.lit(0)), lambda m: F.trim(m))  # by itself, trim would take the position as what to trim
    return F.array_distinct(F.array_compact(F.transform(F.transform(found, parse), render)))


def scrape(c: Column) -> Column:
    """The dated identifiers of a page, by a plain pattern: `IS 269:2015`. A part is read over and left out; repeats stay."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SCRAPE), F.lit(0))
    return F.transform(found, lambda m: F.concat(F.lit("IS "), F.regexp_extract(m, SCRAPE, 1), F.lit(":"), F.regexp_extract(m, SCRAPE, 2)))
