"""WARC captures: not-modified revisits resolved to the latest earlier full response, with merged headers."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.common import range_bucket, sortable, stored

#: Header fields that a 304 may bring up to date; all others stay as the full response had them.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
CAPTURE = "url string, at timestamp, record_id string, kind string, status int, digest string, headers map<string,string>, payload binary"
#: Query parameters that only follow visitors.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """One form of the addresses that name one page.

    The scheme, "www.", a default port, the fragment, tracking parameters and a closing slash go; the host is in lower case.
    """
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), rf"&{TRACKING}=[^&]*", ""), "^&", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _field(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _strong(tag: Column) -> Column:
    """An entity tag without the mark of weakness: a 304 compares weakly."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit: what it stands for.

    ``captures``: url, at, record_id, kind ("response" or "revisit"), status, digest, headers (names in lower
    case); other columns are not read. A revisit goes with the latest full response (kind response, status
    200) of its canonical URL that is earlier, or as early with a smaller record id. Validators that both name must agree:
    the entity tag, by weak comparison; without one, the date of the last change; the digest, where the revisit has
    one. Columns: record_id, url_key, at, outcome, target_id, target_at, digest, headers. ``outcome``: resolved; mismatch
    (a validator differs; target named, headers null); unverified (nothing to compare); no_target. Headers are
    those of the response, with the PERMITTED fields of the revisit laid over them, sorted by name.

    Null headers are empty, null times come first, repeated rows are answered each. Payloads are not moved: ``target_id``
    names them. The timeline is cut into sampled ranges of (URL, time), so an address with a third of all captures is spread;
    the last response of each range is carried to the later ranges of its address.
    """
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    rows = captures.select(
        canonical_url(F.col("url")).alias("u"), F.col("at"), F.coalesce("record_id", F.lit("")).alias("r"), F.col("record_id").alias("named"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), (F.col("kind") == "revisit").alias("asks"),
        "digest", F.coalesce("headers", empty).alias("headers")).where("full OR asks")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = rows.withColumn("b", range_bucket(rows, F.concat(
        F.hex(F.substring(F.col("u").cast("binary"), 1, 96)), F.lit(" "), sortable(F.xxhash64("u")), sortable(micros))))
    target = F.struct(F.col("at").alias("at"), F.col("named").alias("id"), F.col("digest").alias("digest"), F.col("headers").alias("headers"))
    full = F.when(F.col("full"), target)
    order = Window.partitionBy("b", "u").orderBy("at", "r", F.col("asks"))
    placed = rows.withColumn("target", F.last(full, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # the last response of an address in each range, for the ranges after it: at most a row for each range and address at its border
    lasts = rows.where("full").groupBy("b", "u").agg(F.max_by(target, F.struct("at", "r")).alias("last"))
    spans = rows.groupBy("u").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("u")
    held = rows.join(spans, "u", "left_semi").select("u", "b").distinct().join(lasts, ["u", "b"], "left")
    before = Window.partitionBy("u").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("u", "b", F.last("last", ignorenulls=True).over(before).alias("carried"))
    asks = placed.where("asks").join(carried, ["u", "b"], "left").withColumn("target", F.coalesce("target", "carried"))
    t, mine = F.col("target.headers"), F.col("headers")
    tag, changed = _field(mine, "etag"), _field(mine, "last-modified")
    checks = F.array_compact(F.array(
        F.when(tag.isNotNull() & _field(t, "etag").isNotNull(), _strong(tag) == _strong(_field(t, "etag"))),
        F.when((tag.isNull() | _field(t, "etag").isNull()) & changed.isNotNull() & _field(t, "last-modified").isNotNull(),
               changed == _field(t, "last-modified")),
        F.when(F.col("digest").isNotNull() & F.col("target.digest").isNotNull(), F.col("digest") == F.col("target.digest"))))
    outcome = (F.when(F.col("target").isNull(), "no_target").when(F.exists(checks, lambda x: ~x), "mismatch")
               .when(F.size(checks) == 0, "unverified").otherwise("resolved"))
    over = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    rest = F.map_filter(t, lambda k, v: ~F.map_contains_key(over, k))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(rest, over)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return asks.select(
        F.col("named").alias("record_id"), F.col("u").alias("url_key"), "at", outcome.alias("outcome"), F.col("target.id").alias("target_id"),
        F.col("target.at").alias("target_at"), F.coalesce("target.digest", "digest").alias("digest"),
        F.when(outcome.isin("resolved", "unverified"), merged).alias("headers"))


# ---- files ----

def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, plain or of gzip members; a cut last record ends it."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        body = stream.read(int(fields.get("content-length", "0") or 0))
        yield fields, body


def _http(body: bytes) -> tuple[int | None, dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    status = re.match(r"HTTP/\S+\s+(\d{3})", lines[0])
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return int(status[1]) if status else None, fields, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures (CAPTURE) of the responses and revisits in WARC files, plain or gzipped; a file is read by one task."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, body in _records(content):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    status, headers, payload = _http(body)
                    digest = fields.get("warc-payload-digest") or ("sha1:" + hashlib.sha1(payload).hexdigest() if kind == "response" else None)
                    rows.append((fields.get("warc-target-uri"), pd.Timestamp(fields["warc-date"]) if "warc-date" in fields else None,
                                 fields.get("warc-record-id"), kind, status, digest, headers, payload))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, CAPTURE)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log that the pages table implies, for the query: full fetches of each page, and one visit of a cache.

    The first fetch follows the page id by the minute; two of three pages are fetched again some days later, every fourth of them changed. The
    visit comes between eleven days before and five weeks after the first fetch, as the id decides: before any fetch, between two, or
    after both. It names validators of the first fetch: none, a date, a digest, or a weak tag (every other one with a digest).
    """
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    start = F.lit(1_700_000_000) + p * 60
    day = F.date_add(F.lit("2020-09-13").cast("date"), F.pmod(p, F.lit(50)).cast("int"))
    changed = F.pmod(p, F.lit(4)) == 0
    again = F.sha2(F.concat(html, F.when(changed, F.lit("2")).otherwise(F.lit(""))).cast("binary"), 256)
    base = pages.select("url", "page_id", F.lpad(p.cast("string"), 12, "0").alias("id"), start.alias("t"), day.alias("day"),
                        F.sha2(html.cast("binary"), 256).alias("sha"), again.alias("sha2"), F.date_add(day, F.when(changed, 1).otherwise(0)).alias("day2"))

    def tag(sha: str) -> Column:
        return F.concat(F.lit('"'), F.substring(sha, 1, 16), F.lit('"'))

    def digest(sha: str) -> Column:
        return F.concat(F.lit("sha256:"), F.col(sha))

    def fields(*pairs: tuple[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())

    def fetch(rows: DataFrame, mark: str, t: Column, sha: str, day: str) -> DataFrame:
        return rows.select(
            "url", F.timestamp_seconds(t).alias("at"), F.concat(F.lit(mark), "id").alias("record_id"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
            digest(sha).alias("digest"), fields(("content-type", F.lit("text/html")), ("etag", tag(sha)), ("last-modified", F.col(day).cast("string")),
                                                ("cache-control", F.lit("max-age=60")), ("date", t.cast("string"))).alias("headers"))
    first = fetch(base, "r", F.col("t"), "sha", "day")
    second = fetch(base.where(F.pmod(p, F.lit(3)) != 1), "q", F.col("t") + 86_400 * (5 + F.pmod(p, F.lit(11))), "sha2", "day2")
    t, kind = F.col("t") + F.pmod(p * 7919, F.lit(4_000_000)) - 1_000_000, F.pmod(p, F.lit(7))
    visit = base.select(
        F.concat("url", F.lit("#again")).alias("url"), F.timestamp_seconds(t).alias("at"), F.concat(F.lit("v"), "id").alias("record_id"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when((kind == 3) | ((kind > 3) & (F.pmod(p, F.lit(2)) == 0)), digest("sha")).alias("digest"),
        fields(("etag", F.when(kind > 3, F.concat(F.lit("W/"), tag("sha")))), ("last-modified", F.when(kind.isin(1, 2) | (kind > 3), F.col("day").cast("string"))),
               ("cache-control", F.lit("max-age=3600")), ("content-type", F.lit("ignored")), ("date", t.cast("string"))).alias("headers"))
    return first.unionByName(second).unionByName(visit)
