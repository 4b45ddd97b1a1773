"""Merging sources, editions, supersession and coverage over rows of versioned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_sources(rows: DataFrame, key: str, rank: str, seq: str, text: list[str], flags: list[str] = ()) -> DataFrame:
    """One row per key from rows of several sources: each text field from the row with the highest rank that has it (later rows
    win ties), flags true if any source says so, and the sources' ranks in order. One aggregation, partial before the shuffle."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    best = [F.max_by(full(c), F.when(full(c).isNotNull(), F.struct(rank, seq))).alias(c) for c in text]
    return rows.groupBy(key).agg(*best, *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags], F.array_sort(F.collect_set(rank)).alias("sources"))


def dedupe(rows: DataFrame, key: str, seq: str, text: list[str], all_of: list[str] = (), any_of: list[str] = (), longest: list[str] = ()) -> DataFrame:
    """One row per key: the first non-blank of each text field, flags by AND or OR, the longest of long fields (first of equals)."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.groupBy(key).agg(
        *[F.min_by(full(c), F.when(full(c).isNotNull(), F.col(seq))).alias(c) for c in text],
        *[F.bool_and(c).alias(c) for c in all_of],
        *[F.bool_or(c).alias(c) for c in any_of],
        *[F.max_by(c, F.struct(F.length(c), -F.col(seq))).alias(c) for c in longest],
    )


def resolve_editions(rows: DataFrame, key: str, year: str, seq: str, name: str) -> DataFrame:
    """is_current and superseded_by: of the rows with a key the newest dated one is current (the first of equals) and supersedes
    the others; keys without a dated row stay current."""
    w = Window.partitionBy(key).orderBy(F.col(year).desc_nulls_last(), seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = F.first(F.col(year), ignorenulls=False).over(whole).isNotNull()
    newest = F.first(name).over(whole)
    current = ~dated | (F.row_number().over(w) == 1)
    return rows.withColumn("is_current", current).withColumn("superseded_by", F.when(~current, newest))


def supersession(editions: DataFrame, name: str = "designation", by: str = "superseded_by") -> DataFrame:
    """Edges from withdrawn rows to their replacement, and whether the replacement is in the data."""
    own = editions.select(F.col(name).alias("r_name"), F.col("year").alias("replacement_year")).groupBy("r_name").agg(F.max("replacement_year").alias("replacement_year"))
    edges = editions.where(F.col(by).isNotNull())
    return edges.join(own, F.col(by) == F.col("r_name"), "left").withColumn("in_dataset", F.col("r_name").isNotNull()).drop("r_name")


def coverage(wanted: DataFrame, corpus: DataFrame, key: str, item: str) -> DataFrame:
    """Each wanted (key, product) once, with the corpus items of its key, newest name first, and whether there is any."""
    held = corpus.groupBy(key).agg(F.sort_array(F.collect_list(item), asc=False).alias("matches"))
    return wanted.dropDuplicates([key, "product"]).join(held, key, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>"))).withColumn("held", F.size("matches") > 0).withColumn("best_match", F.get("matches", F.lit(0)))


def coverage_summary(rows: DataFrame, key: str) -> DataFrame:
    wanted, held = F.countDistinct(key), F.countDistinct(F.when(F.col("held"), F.col(key)))
    return rows.agg(wanted.alias("wanted"), held.alias("held"), F.when(wanted > 0, F.round(100.0 * held / wanted, 1)).otherwise(0.0).alias("pct"))


def swap_current_first(rows: DataFrame, query: str, key: str, pos: str, current: str) -> DataFrame:
    """Where a withdrawn edition is ahead of its first current one, the two change places; nothing else moves."""
    w = Window.partitionBy(query, key)
    c, s = F.min(F.when(F.col(current), F.col(pos))).over(w), F.min(F.when(~F.col(current), F.col(pos))).over(w)
    swap = s < c
    return rows.withColumn("new_pos", F.when(swap & (F.col(pos) == s), c).when(swap & (F.col(pos) == c), s).otherwise(F.col(pos)))


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Counts of each value of several facets, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in facets.items()]))
    return rows.select(each.alias("f")).select("f.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def matches(where: dict) -> Column:
    """A metadata predicate: {field: value}, $eq $ne $gt $gte $lt $lte $in, $and, $or; several keys are all needed.

    Missing fields satisfy $ne and nothing else; an unknown operator is ignored. Never null, so it can be negated and is pushed
    down to the scan.
    """
    out = F.lit(True)
    for field, cond in where.items():
        if field in ("$and", "$or"):
            parts = [matches(x) for x in cond]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if field == "$and" else one | p
            out = out & one
            continue
        c = F.col(field)
        for op, v in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
            test = {"$eq": lambda c=c, v=v: c == F.lit(v), "$gt": lambda c=c, v=v: c > v, "$gte": lambda c=c, v=v: c >= v, "$lt": lambda c=c, v=v: c < v, "$lte": lambda c=c, v=v: c <= v, "$in": lambda c=c, v=v: c.isin(list(v))}.get(op)
            if op == "$ne":
                out = out & ~c.eqNullSafe(F.lit(v))
            elif test:
                out = out & F.coalesce(test(), F.lit(False))
    return out


def where_of(divisions: list[str] = (), committees: list[str] = (), current_only: bool = False, year_from: int | None = None, year_to: int | None = None) -> dict | None:
    """The predicate that a question implies; one year if both bounds are the same, none if it says nothing."""
    parts = [{"division": {"$in": list(divisions)}}] if divisions else []
    parts += [{"committee": {"$in": list(committees)}}] if committees else []
    parts += [{"is_current": True}] if current_only else []
    if year_from and year_from == year_to:
        parts.append({"year": year_from})
    else:
        parts += [{"year": {"$gte": year_from}}] if year_from else []
        parts += [{"year": {"$lte": year_to}}] if year_to else []
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def where_json(divisions: Column, committees: Column, current_only: Column, year_from: Column, year_to: Column) -> Column:
    """The same predicate for each row of a frame of questions, as JSON; null if a question says nothing."""
    names = lambda f, c: F.when(F.size(c) > 0, F.concat(F.lit(f'{{"{f}":{{"$in":'), F.to_json(c), F.lit("}}")))
    bound = lambda op, c: F.when(c.isNotNull() & ~year_from.eqNullSafe(year_to), F.concat(F.lit(f'{{"year":{{"${op}":'), c.cast("string"), F.lit("}}")))
    one = F.when(year_from == year_to, F.concat(F.lit('{"year":'), year_from.cast("string"), F.lit("}")))
    parts = F.array_compact(F.array(names("division", divisions), names("committee", committees), F.when(current_only, '{"is_current":true}'), one, bound("gte", year_from), bound("lte", year_to)))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(F.size(parts) > 1, F.concat(F.lit('{"$and":['), F.array_join(parts, ","), F.lit("]}")))


def constrains(where: dict | None, field: str) -> bool:
    """Whether a predicate asks for a field anywhere."""
    if not isinstance(where, dict):
        return False
    return any(any(constrains(x, field) for x in v) if k in ("$and", "$or") else k == field for k, v in where.items())


def first_filled(*tiers: tuple[str, DataFrame]) -> DataFrame:
    """The rows of the first tier that has any, with its name as `tier`; the last one whatever it has. Asks for one row of each."""
    for name, df in tiers[:-1]:
        if df.limit(1).count():
            return df.withColumn("tier", F.lit(name))
    return tiers[-1][1].withColumn("tier", F.lit(tiers[-1][0]))


def by_prefix(queries: DataFrame, rows: DataFrame, q: str, name: str) -> DataFrame:
    """(q, name): for each text the first name, in order of the alphabet, that begins with it, whatever the case. An equality join on
    the beginnings of names, which are few for each; of rows with the same name, and of names with the same beginning, only the first goes on."""
    low = F.upper(name)
    heads = rows.where(F.length(name) > 0).select(name).distinct().select(F.col(name).alias("_name"), F.explode(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substr(low, F.lit(1), i))).alias("_head"))
    first = heads.groupBy("_head").agg(F.min("_name").alias("_name"))
    return queries.select(F.col(q).alias("_q")).distinct().join(first, F.upper("_q") == F.col("_head")).select(F.col("_q").alias(q), F.col("_name").alias(name))


def numbered(rows: DataFrame, key: str, order: str, width: int = 100_000) -> DataFrame:
    """`pos`: the place of each row among those of its key, by a whole-numbered `order`. Ranked within ranges of it, to which the
    counts of earlier ranges are added, so no task takes a key whole."""
    cut = rows.withColumn("_range", F.floor(F.col(order) / width))
    n = cut.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select(key, "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    rn = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    return cut.withColumn("_rn", rn).join(base, [key, "_range"]).withColumn("pos", (F.col("_base") + F.col("_rn")).cast("long")).drop("_range", "_rn", "_base")


def chains(editions: DataFrame, name: str = "designation", by: str = "superseded_by") -> DataFrame:
    """(base, n, chain): of each document that lost editions, oldest first, how many and what replaced each. Editions of one document
    are few."""
    old = editions.where(F.coalesce(by, F.lit("")) != "").select(F.split(name, ":")[0].alias("base"), "year", F.col(name).alias("o"), F.col(by).alias("n"))
    g = old.groupBy("base").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("year", "o", "n"))).alias("x"))
    return g.select("base", "n", F.transform("x", lambda e: F.concat(e["o"], F.lit(" -> "), e["n"])).alias("chain"))


def graded(rows: DataFrame) -> DataFrame:
    """`score` and `grade` of rows (expected, present, conflicts, current, resolved): 0.7 for what is there of the mandatory, 0.2 for
    current editions, 0.1 for no conflict; 0.5 and 0.5 if nothing is mandatory. What misses a mandatory key grades PARTIALLY
    at best, and an unverified list never proves FULLY."""
    free, ratio = (F.col("conflicts") == 0).cast("double"), F.col("current") / F.col("resolved")
    score = F.when(F.col("expected") > 0, 0.7 * F.col("present") / F.col("expected") + 0.2 * ratio + 0.1 * free).otherwise(0.5 * ratio + 0.5 * free)
    missing = F.col("present") < F.col("expected")
    grade = F.when(missing & (score >= 0.5), "PARTIALLY COMPLIANT").when(missing, "NON-COMPLIANT").when(score >= 0.7, "MOSTLY COMPLIANT").when(score >= 0.5, "PARTIALLY COMPLIANT").otherwise("NON-COMPLIANT")
    return rows.withColumn("score", score).withColumn("grade", grade)


def assess(identified: DataFrame, supplied: DataFrame, mandatory: DataFrame, query: str = "q") -> DataFrame:
    """One graded row for each query that supplies editions: identified (query, key, verdict) as of `overlap.identify`, supplied (query,
    key, is_current), mandatory (key). Expected are the key of an identified product and all supplied mandatory keys; what is
    ambiguous or weak counts as candidates only. A conflict is a key with several supplied editions."""
    sure = identified.where(F.col("verdict") == "identified").select(query, "key")
    expected = sure.union(supplied.join(mandatory, "key", "left_semi").select(query, "key")).distinct()
    held = supplied.groupBy(query, "key").agg(F.count("*").alias("n"), F.sum(F.col("is_current").cast("long")).alias("c"))
    x = expected.join(held.select(query, "key", F.lit(1).alias("there")), [query, "key"], "left").groupBy(query).agg(F.count("*").alias("expected"), F.count("there").alias("present"))
    k = held.groupBy(query).agg(F.sum("n").alias("resolved"), F.sum("c").alias("current"), F.sum((F.col("n") > 1).cast("long")).alias("conflicts"))
    open_ = F.col("verdict").isin("ambiguous", "weak")
    v = identified.groupBy(query).agg(F.min("verdict").alias("verdict"), F.sum(open_.cast("long")).alias("candidates"), F.min(F.when(open_, F.col("key"))).alias("first_candidate"))
    rows = k.join(x, query, "left").join(v, query, "left")
    return graded(rows.fillna(0, ["expected", "present", "candidates"]))


def recommend(candidates: DataFrame, query: str = "q", first: int = 5, others: int = 10) -> DataFrame:
    """`section` and `place` of each query's candidates (query, seq, role, mandatory, score): product standards as `primary`, all else as
    `related`, each by mandatory, score and seq, cut to `first` and `others` rows."""
    is_first = F.col("role") == "product_standard"
    w = Window.partitionBy(query, is_first).orderBy(F.desc("mandatory"), F.round("score", 6).desc(), "seq")
    ranked = candidates.withColumn("section", F.when(is_first, "primary").otherwise("related")).withColumn("place", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("place") <= F.when(is_first, first).otherwise(others))


def temporal_statistics(editions: DataFrame) -> DataFrame:
    """One row: earliest and latest year, rows in all, current and superseded ones, the mean year cut to a whole number."""
    c = F.col("is_current").cast("long")
    return editions.agg(F.min("year").cast("long").alias("earliest_year"), F.max("year").cast("long").alias("latest_year"), F.count("*").alias("total"), F.sum(c).alias("current"), F.sum(1 - c).alias("superseded"), F.floor(F.avg("year")).cast("long").alias("average_year"))


#: How descriptions spell grades and sizes.
GRADE, CONCRETE, SIZE = r"\b(33|43|53)\s+grade\b", r"\b(m\d{2}|m\d{3})\b", r"\b(\d+)\s*mm\b"


def attributes(text: Column) -> dict[str, Column]:
    """Grades and sizes that a product description names."""
    t = F.lower(F.coalesce(text, F.lit("")))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    return {"grade": every(GRADE), "concrete_grade": every(CONCRETE), "size": every(SIZE)}
