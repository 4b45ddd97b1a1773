"""The queries of this subpackage: thin digests over the operators, for the whole table each is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hostrules, linededup, lm, packing, resample, simhash, suffixdedup, tokenfile, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hostrules.verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures", F.round("host_rate", 6).alias("host_rate"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), with_kept=False)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_host_rules": op6_host_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_files": op8_token_files,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_resampling": op11_resampling,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op2_warc_revisits": r"""
WITH b AS (SELECT page_id AS p, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS u, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
q AS (SELECT p, tag, size, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)'))) AS par FROM b),
c AS (SELECT p, tag, size, host || path || CASE WHEN len(par) > 0 THEN '?' || array_to_string(par, '&') ELSE '' END AS url FROM q),
r AS (SELECT p * 3 + 1 AS id, url, p + 1000 AS "at", tag, 1 AS kind FROM c UNION ALL SELECT p * 3 + 2, url, p - 500, tag, 2 FROM c),
a AS (SELECT r.*, (SELECT max(c.p) FROM c WHERE c.url = r.url AND c.p < r."at") AS rp FROM r),
j AS (SELECT a.*, c.tag AS rtag, c.size AS rsize, CASE WHEN rp IS NULL THEN 'no_response' WHEN a.tag <> c.tag THEN 'mismatch' ELSE 'resolved' END AS outcome FROM a LEFT JOIN c ON c.p = a.rp)
SELECT id, url AS canonical_url, "at", rp * 3 AS response_id, outcome, CASE
  WHEN outcome = 'resolved' AND kind = 1 THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || rsize || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || "at" || chr(10) || 'etag: W/' || tag
  WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || rsize || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || "at" || chr(10) || 'etag: ' || tag || chr(10) || 'expires: 0'
  WHEN kind = 1 THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/plain' || chr(10) || 'date: ' || "at" || chr(10) || 'etag: W/' || tag
  ELSE 'date: ' || "at" || chr(10) || 'etag: ' || tag || chr(10) || 'expires: 0' END AS headers FROM j""",
    "op6_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i + 1:i + 8], ' ') AS g FROM w, unnest(range(0, len(words) - 7)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 8)) AS v(j) GROUP BY rid),
base AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
h AS (SELECT source AS h, count(*) AS host_docs, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS host_failures FROM f GROUP BY source),
tot AS (SELECT CAST(sum(host_docs) AS DOUBLE) AS n, CAST(sum(host_failures) AS DOUBLE) / sum(host_docs) AS m, count(*) AS k,
  sum(CAST(host_failures AS DOUBLE) * host_failures / host_docs) AS q FROM h),
var AS (SELECT n, m, greatest(q / n - m * m, 0) - m * (1 - m) * k / n AS own FROM tot),
pri AS (SELECT m, CASE WHEN own <= 0 THEN n ELSE least(greatest(m * (1 - m) / own - 1, 1), n) END AS s FROM var),
r AS (SELECT h.*, (host_failures + m * s) / (host_docs + s) AS rate FROM h, pri)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, host_docs, host_failures, round(rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.h""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS g FROM d, unnest(range(0, len(l) - 2)) AS u(i)),
dup AS (SELECT doc_id, list(i) AS p FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, i, l[i + 1] AS line, coalesce(list_has_any(p, [i, i - 1, i - 2]), false) AS cut FROM d LEFT JOIN dup USING (doc_id), unnest(range(0, len(l))) AS u(i)),
o AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(cut AS INT)) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS x FROM ln GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(x) AS kept_chars, md5(x) AS kept_md5 FROM o""",
    "op11_resampling": r"""
WITH ct AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
tx AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT side, rid, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM tx),
fe AS MATERIALIZED (SELECT side, rid, array_to_string(w[i:i + k - 1], ' ') AS f FROM w, unnest([1, 2, 3]) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i)),
hx AS (SELECT f, list_transform(string_split_regex(regexp_replace(hex(encode(f)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM fe)),
bk AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM hx, ct),
n AS MATERIALIZED (SELECT b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM fe JOIN bk USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
d AS (SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fe JOIN bk USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY rid),
sc AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d USING (rid) WHERE side = 0),
rk AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS r, count(*) FILTER (WHERE n_words >= 20) OVER () * 5 // 100 AS most FROM sc)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM rk""",
}
