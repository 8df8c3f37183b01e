"""The operators applied to their whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm import alignment, decontaminate, langid, linededup, mainhtml, mixing, personal, sharding, simhash, topk, toxicity, urlfilter, whitening
from factorlab.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query()
def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = sharding.size_bytes().alias("size")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    rows = sharding.shard(docs, 24, carry=["doc_id", size, crc])
    return rows.select("row.*", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


OP2 = r"""
WITH lower AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS x
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM items WHERE len(w) > 0)),
places AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows)),
hits AS (
    SELECT doc_id, item_id, p, n FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS x FROM places)
    JOIN windows USING (n, x)),
hit_words AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query(OP2)
def op2_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.flag(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = langid.predict(docs.drop("lang"), langid.fit(docs))
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _fits(rule: str) -> str:
    domain, _, start = rule.partition("/")
    return f"((host = '{domain}' OR host LIKE '%.{domain}') AND path LIKE '/{start}%')"


def _alone(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::INT"


OP4 = f"""
WITH parts AS (
    SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
           translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
hosts AS (
    SELECT *, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS h FROM parts),
split AS (
    SELECT page_id, low, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM hosts),
ruled AS (
    SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r)))} END AS rule
    FROM split),
weighed AS (
    SELECT *, {' + '.join(f"{w} * {_alone(t)}" for t, w in urlfilter.TERMS.items())} AS weight FROM ruled)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())}
       WHEN weight >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM weighed
"""


@query(OP4)
def op4_url_filter(spark, sf_dir):
    rows = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


OP5 = r"""
WITH parts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
    SELECT doc_id, i, p[i] AS line, translate(trim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
often AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
    SELECT l.*, o.key IS NOT NULL AND doc_id <> keeper AS dropped FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query(OP5)
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    state = linededup.insert(linededup.State(), docs)
    return linededup.dedup(docs, state).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_main_text(spark, sf_dir):
    pages = mainhtml.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "path")


OP7 = r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
    FROM documents),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
    FROM sizes GROUP BY source),
weighed AS (
    SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
           2.0::DOUBLE * source_size AS most FROM totals),
filled AS (  -- by how soon a source is full: what is dealt out if it and those before stop
    SELECT *, most / weight AS full_at, coalesce(sum(most) OVER before, 0) AS used,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS still_open
    FROM weighed WINDOW before AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
unit AS (
    SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - used) / still_open AS unit FROM filled
    WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - used) / still_open <= full_at
    ORDER BY full_at, nth LIMIT 1),
targets AS (
    SELECT source, source_size, least(most, unit * weight) AS target FROM weighed, unit),
plans AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
owed AS (
    SELECT source, source_size, target, floor(ratio) AS copies, ratio - floor(ratio) AS p,
           target - floor(ratio) * source_size AS owed FROM plans),
ranked AS (
    SELECT s.doc_id, s.size, o.*, sum(s.size) OVER (PARTITION BY s.source ORDER BY u, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM sizes s JOIN owed o ON s.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN p > 0 AND (upto <= owed OR (upto - size < owed AND upto - owed < owed - (upto - size)))
                THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""


@query(OP7)
def op7_mixing(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8 = r"""
WITH bits AS (
    SELECT vec_id, CASE WHEN i = 64 THEN (CASE WHEN x > 0 THEN 1 ELSE 0 END)::HUGEINT * 9223372036854775808
                        ELSE (CASE WHEN x > 0 THEN 1 ELSE 0 END)::HUGEINT << (i - 1)::INT END AS b
    FROM (SELECT vec_id, unnest(embedding[1:64]) AS x, unnest(range(1, len(embedding[1:64]) + 1)) AS i FROM embeddings)),
codes AS (SELECT vec_id, sum(b)::UBIGINT AS code FROM bits GROUP BY vec_id),
near AS (
    SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code))::INT AS distance
    FROM codes q, codes r WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance
FROM near QUALIFY rank <= 10
"""


@query(OP8)
def op8_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.binary_code().alias("code"))
    found = topk.top_k(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


@query()
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted",
                                              "evidence")


@query()
def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op11_whitening(spark, sf_dir):
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.lit(np.array(model.values / model.trace if len(model.values) else [], dtype=np.float64))
    long = rows.select("vec_id", F.col("deviation").cast("bigint").alias("deviation"),
                       F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                       "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))


@query()
def op12_personal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = personal.spans(docs, personal.fit(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in personal.KINDS]
    return rows.select("doc_id", *counts, F.sha2(personal.spelled("base"), 256).alias("base_sha256"),
                       personal.spelled("spans").alias("spans"))


@query()
def op13_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = alignment.score(alignment.align(docs, *alignment.tokenizers()))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.col("groups").alias("groups_sha256"))
