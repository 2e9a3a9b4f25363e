"""Queries of the corpus operators, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    credentials, decontamination, filter_audit, inner_product, jaccard, license_scan, packing, quality, simhash, spelling, token_files, url_rules, warc_bundles,
)
from .common import WORD_PATTERN, table

TOKENIZER = "word_bpe_49k.json"
QUALITY_THRESHOLD = 0.3
QUERY_EVERY = 20
#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.get("matches", F.lit(0))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        longest["item_id"].alias("longest_item"), longest["n_words"].alias("longest_words"),
        longest["item_word"].alias("longest_item_word"), longest["doc_word"].alias("longest_doc_word"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(credentials.find_secrets(table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, with_ids=False)


def op4_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inner_product.build_index(table(spark, sf_dir, "embeddings"))
    return inner_product.search(index, index.rows.where(F.col("vec_id") % QUERY_EVERY == 0), k=20)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_bundles.write_warc(table(spark, sf_dir, "pages"))
    return warc_bundles.read_warc(archive, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.read_tokens(files, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_secret_scan, op3_best_fit_packing, op4_inner_product_search, op5_url_rules,
        op6_quality_classifier, op7_warc_bundles, op8_license_scan, op9_token_files, op10_simhash,
        op11_jaccard_join, op12_spelling_variants, op13_filter_audit, pipeline,
    )
}

LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL.format("text")}, '{WORD_PATTERN}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER_SQL.format("text")}, '{WORD_PATTERN}') AS w FROM benchmark),
win AS (SELECT b, item_id, k, i AS j, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT b, item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)),
occ AS (SELECT g1.r, g1.k, g1.i, win.b, win.item_id, win.j FROM grams g1 JOIN win ON g1.k = win.k AND g1.g = win.g),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occ GROUP BY r),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
runs AS (SELECT r, b, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + any_value(k) - 1 AS n
         FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS run FROM occ) GROUP BY r, b, item_id, i - j, run),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, item_id NULLS LAST, item_word, doc_word) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       best.item_id AS longest_item, CAST(best.n AS BIGINT) AS longest_words, CAST(best.item_word AS BIGINT) AS longest_item_word, CAST(best.doc_word AS BIGINT) AS longest_doc_word
FROM d LEFT JOIN items USING (r) LEFT JOIN hits USING (r) LEFT JOIN best USING (r)
""",
    "op5_url_rules": """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
""",
    "op7_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, html, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1) for i in range(0, 32)], '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response_id FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN NULL ELSE response_id END AS refers_to
FROM m
""",
}


def _any_case(words: str) -> str:
    """A pattern of ASCII words in either case, for an engine whose case folding goes beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _secret_sql() -> str:
    label = """["'']?\\x20*[:=]\\x20*["'']?"""
    kinds = {
        "assign": (f"({_any_case('password|passwd|secret|token|api_?key')}){label}([A-Za-z0-9+/_.=-]+)", 2, "length(v) >= 6"),
        "access": ("AKIA[A-Z0-9]+", 0, "length(v) >= 20"),
        "hex": ("[0-9a-f]{24,}", 0, "true"),
        "identifier": (f"({_any_case('client_?id|access_?key_?id|user_?name|login')}){label}([A-Za-z0-9@._-]+)", 2, "length(v) >= 3"),
        "opaque": ("[A-Za-z0-9+/]{40,}", 0, "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')"),
        "endpoint": ("""[a-z][a-z0-9+]{1,15}://[^\\x09-\\x0D\\x20"''<>]+""", 0, "true"),
        "break": ("\\n[\\x20\\t]*\\n", 0, "true"),
    }
    found = " UNION ALL ".join(
        f"""SELECT r, '{k}' AS kind, {n} AS rank, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS w, unnest(g) AS v, unnest(s[1:len(m)]) AS b
FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}'))"""
        for n, (k, (p, group, _)) in enumerate(kinds.items(), 1)
    )
    good = " ".join(f"WHEN '{k}' THEN {test}" for k, (_, _, test) in kinds.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
e AS (SELECT *, sum(length(b) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM f),
p AS (SELECT r, kind, rank, CAST(e - length(w) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM e WHERE CASE kind {good} END),
q AS (SELECT *, count(*) FILTER (kind = 'break') OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS scope FROM p),
x AS (SELECT r, scope FROM q GROUP BY r, scope HAVING bool_or(kind IN ('assign', 'hex', 'opaque')) AND bool_or(kind IN ('access', 'identifier', 'endpoint'))),
k AS (SELECT r, kind, rank, s, e FROM p WHERE rank <= 3 UNION ALL SELECT r, kind, rank, s, e FROM q JOIN x USING (r, scope) WHERE rank BETWEEN 4 AND 6),
g AS (SELECT r, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


ORACLES["op2_secret_scan"] = _secret_sql()


ORACLES["op11_jaccard_join"] = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.r = p.a JOIN n AS y ON y.r = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
c AS (SELECT r, r AS o FROM d UNION SELECT l.b AS r, c.o FROM c JOIN l ON l.a = c.r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN c ON c.r = d.r JOIN d AS e ON e.r = c.o GROUP BY d.r, d.doc_id
"""

ORACLES["op13_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x AS a, x AS b, x AS c, x AS d, x AS e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
m AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cells CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
