"""Text functions as column expressions; each has a twin that writes the same function in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no index terms.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()
#: Words that carry no topic in a query.
QUERY_STOPWORDS = """
a an and are as at be been by can could do does for from get give has have how i
in into is it its me my of on or our please should show so some tell than that the
their them then there these this to use used using was we were what when where which
who why will with would you your need needs want about regarding covered
cover under per any all if whether
""".split()
#: Words of nearly every title.
GENERIC_WORDS = """
code codes specification specifications spec standard standards method methods
part parts section sections practice requirement requirements test testing
indian bureau general guide guidelines code of practice
""".split()
#: Words that are no keywords of a record.
COMMON_WORDS = "for the of and or is a an in on at to from with by be part method".split()
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokenize(c: Column) -> Column:
    """Index terms: runs of letters, digits and inner `.-/`, no stopwords, one plural `s` cut from longer terms."""
    raw = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9.\-/]*"), F.lit(0))
    bare = F.filter(F.transform(raw, lambda x: F.btrim(x, F.lit(".-/"))), lambda x: (x != "") & ~x.isin(STOPWORDS))
    return F.transform(bare, lambda x: F.when((F.length(x) > 3) & x.endswith("s") & ~x.rlike("(es|ss|us|is)$"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))


def tokenize_sql(x: str) -> str:
    return (
        f"list_transform(list_filter(list_transform(regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[a-z0-9][a-z0-9.\\-/]*'), lambda t: trim(t, '.-/')), "
        f"lambda t: t <> '' AND NOT list_contains({_list(STOPWORDS)}, t)), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' AND NOT regexp_matches(t, '(es|ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END)"
    )


def bigrams(tokens: Column) -> Column:
    """Neighbouring terms joined by `_`."""
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat(F.get(tokens, i), F.lit("_"), F.get(tokens, i + 1))))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(c: Column, limit: int = 220) -> Column:
    flat = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("..."))).otherwise(flat)


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def words(c: Column) -> Column:
    """Words at white space, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def chunks(w: Column, size: int = 100, overlap: int = 20) -> Column:
    """Windows of `size` words that begin every `size - overlap` words, as texts. `w`: a column of words, made before, as an
    expression would be worked out again for each window."""
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))


def record_keywords(c: Column) -> Column:
    """Up to ten distinct keywords of a title, in order of the alphabet."""
    kept = F.filter(words(F.lower(c)), lambda w: ~w.isin(COMMON_WORDS) & (F.length(w) > 3))
    return F.slice(F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.btrim(w, F.lit(".,()[]"))))), 1, 10)


def query_keywords(c: Column) -> Column:
    """Topic words of a query: three letters at least, no fillers, no designation, no year; each once, in order."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda w: (F.length(w) >= 3) & ~w.isin([*QUERY_STOPWORDS, *GENERIC_WORDS]) & ~w.rlike(r"^(is\d+|\d{4})$")))


def product_tokens(c: Column) -> Column:
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(raw, lambda t: F.when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))
