"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm import (chat, decontamination, exact, filter_audit, html_text, language, neardup, packing, quality, ranked_search, secret_scan,
                             toxicity, warc)
from factorspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_conversations(rows)
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op1_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<|', '\p') AS content,
    replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<|', '\p'), ':', '\c') AS mark
  FROM rows),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (WHERE role = 'assistant'), '') AS learned,
    CAST(sum(length(mark) + length(content) + 14) AS BIGINT) AS formatted_chars
  FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM conv"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"), path="doc_id")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.BASE]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in secret_scan.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def _rule_sql(place: int, rule: secret_scan.Rule) -> str:
    word = "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    p = rule.pattern.replace("((?i:password|passwd|secret|token|api_?key))", word).replace("'", "''")
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, unnest(list_zip(hit, sized, range(1, len(hit) + 1))) AS z, gap, hit
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hit, regexp_extract_all(text, '{p}', {rule.group}) AS sized,
          regexp_split_to_array(text, '{p}') AS gap FROM docs)"""


ORACLES["op5_secret_scan"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
spans AS (
  SELECT doc_id, place, kind, length(z[2]) AS sized, length(z[1]) AS hit_len,
    list_sum(list_transform(gap[1:z[3]], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:z[3] - 1], lambda g: length(g))), 0) AS start
  FROM hits),
good AS (
  SELECT doc_id, place, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + hit_len AS BIGINT) AS span
  FROM spans WHERE kind <> 'assign' OR sized >= 6),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, place) AS spans,
    string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)"""


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


ORACLES["op6_near_dedup"] = r"""
WITH RECURSIVE tok AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM tok WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (SELECT s, count(*) AS df FROM shingles GROUP BY s),
-- two sets that share four fifths share one of the rarest fifth and one more of either
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM shingles JOIN rare USING (s)),
prefix AS (SELECT doc_id, s, n FROM ranked JOIN sizes USING (doc_id) WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT c.a, c.b, count(*) AS k FROM cand c JOIN shingles x ON x.doc_id = c.a JOIN shingles y ON y.doc_id = c.b AND y.s = x.s GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN comp ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language.identifier(spark, model)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenised(table(spark, sf_dir, "documents")))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_matches(docs, table(spark, sf_dir, "benchmark"), "matches", verbatim=True)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_join("matches.item", ",").alias("items"),
                        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"), F.exists("matches", lambda m: m["exact"]).alias("exact"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = html_text.train(pages)
    out = pages.select("page_id", "url", html_text.extractor(spark, model)(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", F.unix_seconds("at").alias("revisit_at"), "outcome", "target_id", F.unix_seconds("target_at").alias("target_at"), "digest", "headers")


ORACLES["op10_warc_revisits"] = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace('&' || regexp_extract(u, '\?(.*)$', 1), '&(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM bare),
base AS (
  SELECT page_id AS p, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS u, 1700000000 + page_id * 60 AS t,
    DATE '2020-09-13' + CAST(page_id % 50 AS INTEGER) AS day, sha256(coalesce(html, '')) AS sha, lpad(CAST(page_id AS VARCHAR), 12, '0') AS idt,
    sha256(coalesce(html, '') || CASE WHEN page_id % 4 = 0 THEN '2' ELSE '' END) AS sha2, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS more
  FROM parts),
resp AS (
  SELECT u, t, 'r' || idt AS id, '"' || substr(sha, 1, 16) || '"' AS tag, CAST(CAST(day AS DATE) AS VARCHAR) AS day, 'sha256:' || sha AS digest FROM base
  UNION ALL SELECT u, t + 86400 * (5 + p % 11), 'q' || idt, '"' || substr(sha2, 1, 16) || '"', CAST(CAST(day + more AS DATE) AS VARCHAR), 'sha256:' || sha2 FROM base WHERE p % 3 <> 1),
rev AS (
  SELECT u, t + (p * 7919) % 4000000 - 1000000 AS t, 'v' || idt AS id, CASE WHEN p % 7 > 3 THEN '"' || substr(sha, 1, 16) || '"' END AS tag,
    CASE WHEN p % 7 IN (1, 2) OR p % 7 > 3 THEN CAST(CAST(day AS DATE) AS VARCHAR) END AS day,
    CASE WHEN p % 7 = 3 OR (p % 7 > 3 AND p % 2 = 0) THEN 'sha256:' || sha END AS digest
  FROM base),
latest AS (
  SELECT v.*, r.id AS target_id, r.t AS target_at, r.tag AS old_tag, r.day AS old_day, r.digest AS old_digest
  FROM rev v LEFT JOIN resp r ON v.u = r.u AND (r.t < v.t OR (r.t = v.t AND r.id < v.id))
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.t DESC NULLS LAST, r.id DESC) = 1),
checked AS (
  SELECT *, tag = old_tag AS c1, CASE WHEN tag IS NULL OR old_tag IS NULL THEN day = old_day END AS c2, digest = old_digest AS c3 FROM latest),
met AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'no_target' WHEN NOT c1 OR NOT c2 OR NOT c3 THEN 'mismatch'
    WHEN c1 IS NULL AND c2 IS NULL AND c3 IS NULL THEN 'unverified' ELSE 'resolved' END AS outcome FROM checked)
SELECT id AS record_id, u AS url_key, t AS revisit_at, outcome, target_id, target_at, coalesce(old_digest, digest) AS digest,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN 'cache-control: max-age=3600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t
    || chr(10) || 'etag: ' || CASE WHEN tag IS NOT NULL THEN 'W/' || tag ELSE old_tag END || chr(10) || 'last-modified: ' || coalesce(day, old_day) END AS headers
FROM met"""


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", (~F.col("taught")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


FILTER_NAMES = "ABCDE"


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filter_audit.failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.interaction_audit(cells, FILTER_NAMES)


ORACLES["op12_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
  FROM documents),
marks AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, copy AS e
  FROM docs LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, sum(good) AS good,
    sum(toxic) AS toxic FROM masks GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM orders, range(1, 6) AS g(step)),
parts AS (SELECT DISTINCT part FROM cells),
counted AS (
  SELECT p.part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM parts p CROSS JOIN steps JOIN cells c ON c.part = p.part GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = r"""
WITH tok AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row, doc_id, w, len(w) AS n FROM tok WHERE len(w) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
terms AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs) GROUP BY 1, 2),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
holding AS (SELECT term, count(*) AS df FROM terms WHERE term IN (SELECT term FROM items) GROUP BY 1),
gains AS (
  SELECT row, term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS gain
  FROM terms JOIN holding USING (term) JOIN docs USING (row) CROSS JOIN total),
scores AS (SELECT item_id, row, CAST(sum(gain) AS BIGINT) AS score FROM gains JOIN items USING (term) GROUP BY 1, 2),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
  FROM scores JOIN docs USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""
