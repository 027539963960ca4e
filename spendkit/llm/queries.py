"""The queries over the test tables, and SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, decontam, exact_dedup, html_extract, jaccard, langid, line_dedup, packing, quality, ranked_search, substring_dedup, url_filter, warc,
)
from .storage import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            CHECKS[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE32 = """
list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr({hex}, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '')
"""


@query("op1_warc", f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h FROM rows),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32.format(hex='h')} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op3_url_filter", f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {', '.join(map(repr, URL_RULES))}),
u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://((?s).*)$', 1, 's') AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT s.page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY s.page_id
    ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS k
  FROM s JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM s LEFT JOIN f ON s.page_id = f.page_id AND k = 1
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_decontamination", r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
d AS (SELECT id, ws FROM w WHERE kind = 'd'), b AS (SELECT id, ws FROM w WHERE kind = 'b' AND len(ws) > 0),
i AS (SELECT DISTINCT id AS item, least(len(ws), 13) AS m, array_to_string(ws[s : s + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM b)),
n AS (SELECT DISTINCT m FROM i),
h AS (SELECT p.id, s, m, item FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, n) p
  JOIN i USING (m) WHERE array_to_string(ws[s : s + m - 1], ' ') = win),
c AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(s, s + m)) AS at FROM h) GROUP BY id),
l AS (SELECT id, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items
  FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT d.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON d.id = c.id LEFT JOIN l ON d.id = l.id
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(item_ids, ','), 256) AS items_sha256", "contaminated",
    )


@query("op9_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, first IS NOT NULL AND doc_id > first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) AS kept_sha256")


@query("op10_jaccard_join", r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)
""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.learn(docs.where(~langid.hold_out()))
    return langid.identify(docs, net).select("doc_id", langid.hold_out().alias("held_out"), "lang_pred", "score")


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~quality.hold_out()))
    return quality.score(docs, model).select("doc_id", quality.hold_out().alias("held_out"), "score", "predicted")


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.selectExpr("page_id", "url", "text", "cast(char_length(text) AS bigint) AS n_chars")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity")


@query("op11_ranked_search", r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM low),
c AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM w WHERE kind = 'd' AND len(ws) > 0),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM w WHERE kind = 'd') GROUP BY ALL),
q AS (SELECT id AS item_id, term, count(*) AS qtf FROM (SELECT id, unnest(ws) AS term FROM w WHERE kind = 'b') GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n),
m AS (SELECT id, 100 - 25 + (25 * len(ws) * n) // l AS m FROM w, c WHERE kind = 'd' AND len(ws) > 0),
s AS (SELECT item_id, id AS doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, k, array_to_string(ws[k : k + 34], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS at FROM r),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w)
SELECT w.doc_id, len(any_value(ws))::BIGINT AS n_words, count(g.at)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY e.at) FILTER (g.at IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN e ON w.doc_id = e.doc_id LEFT JOIN g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY w.doc_id
""")
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) AS kept_sha256")


#: Folder of the tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = f"{TOKENIZERS}/{alignment.A_FILE}", f"{TOKENIZERS}/{alignment.B_FILE}"
    return alignment.align(table(spark, sf_dir, "documents"), a, b)
