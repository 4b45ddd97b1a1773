"""Queries over raw records: pages, events, conversations and loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import designation as D
from ..functions import text as X
from ..functions import values as V
from ..operators import limiter
from ..operators import standards as S
from ..operators.evaluate import percentiles
from .standards import table

QUERIES, SQL = {}, {}

#: Word patterns that tell what a question is about.
COMPLIANCE = r"\b(mandatory|compulsor\w*|qco|quality\s+control\s+order|certif\w*|isi\s+mark|regulat\w*|required\s+by\s+law|legally\s+required|enforce\w*)\b"
SUPERSESSION = r"\b(supersed\w*|obsolet\w*|outdat\w*|withdrawn|replaced?\s+by|latest|newest|current\s+edition|new\s+version|old\s+version|still\s+valid|which\s+edition|revised)\b"
LATEST = r"\b(latest|newest|current)\b"
EXPLAIN = r"\b(what\s+does|explain|summari[sz]e|tell\s+me\s+about|describe|what\s+is\s+covered|scope\s+of|overview)\b"
LISTING = r"\b(list|show|browse|all\s+standards|which\s+standards|standards\s+for|related\s+standards)\b"
HISTORY = r"\b(superseded|obsolete|outdated|withdrawn|old\s+version|history)\b"
NAMED = r"\bis(/iec|/iso)?\s*:?\s*\d+"
PREFIXES = ["is IS 456 mandatory since 2010? ", "latest edition of IS 302 between 1990 and 2005 ", "explain IS 1786 or later 1999 or later ", "IS 10500 ", "list all standards before 1985 ", "", "withdrawn in 1978 "]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def intent(q):
    """What a question wants; its words decide in this order."""
    t, named = F.lower(q), F.lower(q).rlike(NAMED)
    return (
        F.when(t.rlike(COMPLIANCE), "compliance")
        .when(t.rlike(SUPERSESSION), F.when(t.rlike(LATEST), "latest").otherwise("supersession"))
        .when(t.rlike(EXPLAIN) & named, "explain")
        .when(named, "lookup")
        .when(t.rlike(LISTING), "list_by_domain")
        .otherwise("topic_search")
    )


#: The ways in which a question bounds the year; the first group is the year, of BETWEEN also the second.
BETWEEN = r"\bbetween\s+(\d{4})\s+and\s+(\d{4})\b"
FROM_YEAR = [r"\b(\d{4})\s+or\s+(?:later|newer|above)\b", r"\b(?:from|after|since|later\s+than|newer\s+than)\s+(\d{4})\b"]
TO_YEAR = [r"\b(\d{4})\s+or\s+(?:earlier|older|before)\b", r"\b(?:before|until|up\s+to|earlier\s+than|older\s+than)\s+(\d{4})\b"]
BARE_YEAR = r"\b(19[2-9]\d|20[0-4]\d)\b"


def years(q) -> tuple:
    """(from, to): the years that a question asks for."""
    t = F.lower(q)
    got = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("int")
    low, high = F.coalesce(*map(got, FROM_YEAR)), F.coalesce(*map(got, TO_YEAR))
    bare = F.when(low.isNull() & high.isNull() & t.rlike(SUPERSESSION), got(BARE_YEAR))
    return F.coalesce(got(BETWEEN), low, bare), F.coalesce(got(BETWEEN, 2), F.when(got(BETWEEN).isNull(), high))


def _year_sql(t: str) -> str:
    """The same over a lower-case column, as b1, b2, lo, hi, bare."""
    got = lambda p, g=1: f"CAST(nullif(regexp_extract({t}, '{p}', {g}), '') AS INT)"
    return f"{got(BETWEEN)} AS b1, {got(BETWEEN, 2)} AS b2, coalesce({', '.join(map(got, FROM_YEAR))}) AS lo, coalesce({', '.join(map(got, TO_YEAR))}) AS hi, CASE WHEN regexp_matches({t}, '{SUPERSESSION}') THEN {got(BARE_YEAR)} END AS bare"


_PRE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES))


@query(f"""WITH q AS (SELECT conv_id, turn, lower(CASE (conv_id + turn) % {len(PREFIXES)} {_PRE} END || text) AS t FROM conversations), i AS (SELECT *, regexp_matches(t, '{NAMED}') AS named FROM q),
k AS (SELECT *, CASE WHEN regexp_matches(t, '{COMPLIANCE}') THEN 'compliance' WHEN regexp_matches(t, '{SUPERSESSION}') THEN CASE WHEN regexp_matches(t, '{LATEST}') THEN 'latest' ELSE 'supersession' END WHEN regexp_matches(t, '{EXPLAIN}') AND named THEN 'explain' WHEN named THEN 'lookup' WHEN regexp_matches(t, '{LISTING}') THEN 'list_by_domain' ELSE 'topic_search' END AS intent,
  {_year_sql('t')} FROM i)
SELECT conv_id, turn, intent, coalesce(b1, lo, CASE WHEN lo IS NULL AND hi IS NULL THEN bare END) AS year_from, coalesce(b2, CASE WHEN b1 IS NULL THEN hi END) AS year_to, NOT (intent IN ('supersession', 'compliance') OR regexp_matches(t, '{HISTORY}')) AS current_only,
  CASE WHEN intent = 'supersession' THEN 'history' WHEN intent IN ('compliance', 'latest', 'list_by_domain') THEN 'recommend' ELSE 'search' END AS mode FROM k""")
def intent_classify(spark, sf):
    c = table(spark, sf, "conversations")
    pre = F.get(F.array(*[F.lit(p) for p in PREFIXES]), ((F.col("conv_id") + F.col("turn")) % len(PREFIXES)).cast("int"))
    c = c.withColumn("q", F.concat(pre, "text")).withColumn("intent", intent(F.col("q")))
    low, high = years(F.col("q"))
    back = F.col("intent").isin("supersession", "compliance") | F.lower("q").rlike(HISTORY)
    mode = F.when(F.col("intent") == "supersession", "history").when(F.col("intent").isin("compliance", "latest", "list_by_domain"), "recommend").otherwise("search")
    return c.select("conv_id", "turn", "intent", low.alias("year_from"), high.alias("year_to"), (~back).alias("current_only"), mode.alias("mode"))


@query("""WITH w AS (SELECT conv_id, turn, i, lower(w[i + 1]) AS x FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations), unnest(range(0, len(w))) AS u(i)), f AS (SELECT conv_id, x, min(turn * 1000000 + i) AS pl FROM w GROUP BY ALL)
SELECT conv_id, count(*) AS n, md5(string_agg(x, ' ' ORDER BY pl)) AS words_md5 FROM f GROUP BY conv_id""")
def ordered_distinct(spark, sf):
    """The distinct words of a conversation in order of their first use; folded by word before a conversation comes together."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("i", "x"))
    f = w.groupBy("conv_id", F.lower("x").alias("x")).agg(F.min(F.col("turn") * 1000000 + F.col("i")).alias("at"))
    g = f.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return g.select("conv_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.transform("s", lambda e: e["x"]), " ").cast("binary")).alias("words_md5"))


@query("""SELECT doc_id, source AS number, CASE WHEN doc_id % 3 > 0 THEN lang || ' text' END AS title, CAST(1950 + doc_id % 60 AS VARCHAR) AS year FROM documents""")
def label_value_parse(spark, sf):
    """Values of a run-on description, each up to the next label; one label is missing in every third row."""
    from ..sources.items import labelled

    i = F.col("doc_id")
    text = F.concat(F.lit("Number: "), "source", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" TITLE : "), "lang", F.lit(" text"))), F.lit(" Year:"), (1950 + i % 60).cast("string"))
    m = labelled(text, ["Number", "Title", "Year"])
    return table(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m.Number").alias("number"), F.col("m.Title").alias("title"), F.col("m.Year").alias("year"))


FLAT = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT page_id, {FLAT} AS t FROM pages) SELECT page_id, length(t) AS n, md5(t) AS text_md5, CASE WHEN length(t) > 220 THEN rtrim(left(t, 220)) || '...' ELSE t END AS snippet FROM f""")
def html_strip(spark, sf):
    p = table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("text_md5"), X.snippet(F.col("t")).alias("snippet"))


@query("""WITH m AS (SELECT page_id, 'IS ' || (page_id % 50 + 1) || ':' || (1950 + page_id % 60) AS found FROM pages UNION ALL SELECT page_id, 'IS ' || (page_id % 7) || ':1999' FROM pages WHERE page_id % 2 = 0) SELECT found, count(*) AS n, count(DISTINCT page_id) AS pages FROM m GROUP BY found""")
def regex_scrape(spark, sf):
    """Dated identifiers on pages, with the part read over, and on how many pages each is. Invented pages name none, so each gets some
    at its end."""
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    body = F.concat(F.coalesce("html", F.lit("")), F.lit("<li>IS  "), text(i % 50 + 1), F.lit(" (Part 2):"), text(1950 + i % 60), F.lit("</li>"), F.when(i % 2 == 0, F.concat(F.lit("<b>IS "), text(i % 7), F.lit(":1999</b>"))).otherwise("THIS 1:99"))
    m = table(spark, sf, "pages").select("page_id", F.explode(D.scrape(body)).alias("found"))
    return m.groupBy("found").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("""WITH f AS (SELECT doc_id, [{'name': 'a.pdf', 'format': 'PDF', 'private': doc_id % 2 = 0}, {'name': 'a.txt', 'format': 'Text', 'private': doc_id % 3 = 0}, {'name': 'a_djvu.txt', 'format': 'DjVuTXT', 'private': doc_id % 5 = 0}] AS files FROM documents),
p AS (SELECT doc_id, files, list_filter(files, lambda x: NOT x.private) AS o FROM f) SELECT doc_id, coalesce(list_filter(o, lambda x: x.format = 'DjVuTXT')[1].name, list_filter(o, lambda x: x.format = 'Text')[1].name) AS text_file, list_filter(o, lambda x: x.format = 'PDF')[1].name AS pdf_file, len(o) = 0 AS restricted FROM p""")
def derivative_pick(spark, sf):
    """Of an item's public files the one of the preferred format; an item with files of which none is public is restricted."""
    i = F.col("doc_id")
    one = lambda n, f, by: F.struct(F.lit(n).alias("name"), F.lit(f).alias("format"), (i % by == 0).alias("private"))
    d = table(spark, sf, "documents").select("doc_id", F.array(one("a.pdf", "PDF", 2), one("a.txt", "Text", 3), one("a_djvu.txt", "DjVuTXT", 5)).alias("files"))
    from ..sources.items import best_file, is_restricted

    return d.select("doc_id", best_file(F.col("files"), ["DjVuTXT", "Text"]).alias("text_file"), best_file(F.col("files"), ["PDF"]).alias("pdf_file"), is_restricted(F.col("files")).alias("restricted"))


HEADINGS = [["Sl. No", "IS No.", "Product"], ["Product Category", "Indian Standard", "Remarks"], ["Remarks", "IS Number", "IS"], ["Sl No", "Remarks", ""]]


@query("""SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS BIGINT) AS target, 'IS ' || (page_id % 900 + 1) AS spelling, 'longest plain text of the row' AS context FROM pages""")
def column_infer(spark, sf):
    """The column of identifiers by the headings of a page's table, the cell that holds one, and the longest other cell. Invented pages
    have no table, so each gets one at its end."""
    from ..sources import rest

    i = F.col("page_id")
    heads = F.get(F.array(*[F.lit("".join(f"<th>{x}</th>" for x in h)) for h in HEADINGS]), (i % 4).cast("int"))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr>"), heads, F.lit("</tr><tr><td>12.5</td><td>IS&nbsp;"), (i % 900 + 1).cast("string"), F.lit("</td><td>short</td><td>longest plain <b>text</b> of the row</td></tr></table>"))
    pages = table(spark, sf, "pages").select("page_id", html.alias("html"))
    target = rest.table_rows(pages).where("header").select(F.col("page").alias("page_id"), rest.infer_column(F.col("cells")).cast("long").alias("target"))
    found = rest.table_items(pages).select(F.col("page").alias("page_id"), "spelling", "context")
    return target.join(found, "page_id")


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'nan' ELSE lang END AS a, source AS b, n_chars || '.0' AS y, CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'withdrawn' ELSE 'maybe' END AS f FROM documents)
SELECT doc_id, coalesce(nullif(trim(a), ''), b) AS first_value, CASE WHEN a IS NULL OR lower(trim(a)) IN ('', 'nan', 'none', 'null') THEN '' ELSE trim(a) END AS text_value, TRY_CAST(split_part(y, '.', 1) AS INT) AS int_value, CASE WHEN lower(f) = 'yes' THEN true WHEN lower(f) = 'withdrawn' THEN false ELSE true END AS flag FROM r""")
def alias_decode(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    r = d.select("doc_id", F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, " ").when(i % 4 == 2, "nan").otherwise(F.col("lang")).alias("a"), F.col("source").alias("b"), F.concat(F.col("n_chars").cast("string"), F.lit(".0")).alias("y"), F.when(i % 3 == 0, "Yes").when(i % 3 == 1, "withdrawn").otherwise("maybe").alias("f"))
    return r.select("doc_id", V.first_present(F.col("a"), F.col("b")).alias("first_value"), V.as_text(F.col("a")).alias("text_value"), V.as_int(F.col("y")).alias("int_value"), V.as_bool(F.col("f")).alias("flag"))


@query("SELECT doc_id, left(sha256(lang || '/' || source || '/1'), 16) AS fingerprint, sha1(source || '?' || lang) AS cache_key, greatest(0, coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'soon' ELSE CAST(doc_id % 7 - 2 AS VARCHAR) END AS DOUBLE), 0)) AS wait FROM documents")
def fingerprints(spark, sf):
    d = table(spark, sf, "documents")
    after = F.when(F.col("doc_id") % 3 == 0, "soon").otherwise((F.col("doc_id") % 7 - 2).cast("string"))
    return d.select("doc_id", F.left(F.sha2(F.concat_ws("/", "lang", "source", F.lit("1")), 256), F.lit(16)).alias("fingerprint"), F.sha1(F.concat_ws("?", "source", "lang").cast("binary")).alias("cache_key"), F.greatest(F.lit(0.0), F.coalesce(after.try_cast("double"), F.lit(0.0))).alias("wait"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE (n_chars // 1024) || ' KB' END AS size_label, left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 400) AS head FROM documents""")
def text_formatting(spark, sf):
    n = F.col("n_chars")
    kb = F.concat(F.floor(n / 1024).cast("long").cast("string"), F.lit(" KB"))
    return table(spark, sf, "documents").select("doc_id", F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(kb).alias("size_label"), F.left(X.collapse(F.col("text")), F.lit(400)).alias("head"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events")
    p = percentiles(e, "event_type", "value", [0.5, 0.95, 0.99])
    wide = p.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("share") == x, F.col("value"))), 6).alias(n) for x, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.join(wide, "event_type", "left").select("event_type", "n", "p50", "p95", "p99", "mean")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS doc FROM events")
def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_id, user_id, rn, true AS accepted, [t] AS held FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, rn, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END FROM (SELECT e.*, list_filter(g.held, lambda x: x > e.t - 86400000000) AS h FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1))
SELECT event_id, user_id, accepted FROM g""")
def rate_limit(spark, sf):
    """Accepted or denied, event by event: at most 3 accepted in any day of a user, which denies a quarter."""
    return limiter.limit(table(spark, sf, "events"), "user_id", "ts", "event_id", most=3, seconds=86_400)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Tumbling windows of an hour (an extension)."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "1 hour")


@query(f"""WITH q AS (SELECT conv_id, turn, lower(CASE (conv_id + turn) % {len(PREFIXES)} {_PRE} END || CASE turn % 3 WHEN 0 THEN 'small items ' WHEN 1 THEN 'LARGE and Small ' ELSE '' END) AS t FROM conversations), y AS (SELECT conv_id, turn, t, {_year_sql('t')} FROM q),
r AS (SELECT conv_id, turn, t, coalesce(b1, lo, CASE WHEN lo IS NULL AND hi IS NULL THEN bare END) AS a, coalesce(b2, CASE WHEN b1 IS NULL THEN hi END) AS z, list_filter(['LARGE', 'SMALL'], lambda d: contains(t, lower(d))) AS dv FROM y),
c AS (SELECT conv_id, turn, list_filter([CASE WHEN len(dv) > 0 THEN '{{"division":{{"$in":["' || array_to_string(dv, '","') || '"]}}}}' END, CASE WHEN NOT regexp_matches(t, '{SUPERSESSION}') AND NOT regexp_matches(t, '{COMPLIANCE}') AND NOT regexp_matches(t, '{HISTORY}') THEN '{{"is_current":true}}' END, CASE WHEN a = z THEN '{{"year":' || a || '}}' END, CASE WHEN a IS NOT NULL AND a IS DISTINCT FROM z THEN '{{"year":{{"$gte":' || a || '}}}}' END, CASE WHEN z IS NOT NULL AND a IS DISTINCT FROM z THEN '{{"year":{{"$lte":' || z || '}}}}' END], lambda x: x IS NOT NULL) AS p FROM r)
SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN NULL WHEN len(p) = 1 THEN p[1] ELSE '{{"$and":[' || array_to_string(p, ',') || ']}}' END AS predicate, len(list_filter(p, lambda x: contains(x, '"year"'))) > 0 AS by_year FROM c""")
def filter_synthesis(spark, sf):
    """The metadata predicate that each question implies, as JSON, and whether it asks for a year."""
    i, turn = F.col("conv_id"), F.col("turn")
    pre = F.get(F.array(*[F.lit(p) for p in PREFIXES]), ((i + turn) % len(PREFIXES)).cast("int"))
    q = F.concat(pre, F.when(turn % 3 == 0, "small items ").when(turn % 3 == 1, "LARGE and Small ").otherwise(""))
    c = table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"))
    low, high = years(F.col("q"))
    c = c.withColumn("a", low).withColumn("z", high).withColumn("dv", F.filter(F.array(F.lit("LARGE"), F.lit("SMALL")), lambda d: F.contains(F.lower("q"), F.lower(d))))
    back = intent(F.col("q")).isin("supersession", "latest", "compliance") | F.lower("q").rlike(HISTORY)
    p = S.where_json(F.col("dv"), F.array().cast("array<string>"), ~back, F.col("a"), F.col("z"))
    return c.select("conv_id", "turn", p.alias("predicate"), (F.col("a").isNotNull() | F.col("z").isNotNull()).alias("by_year"))
