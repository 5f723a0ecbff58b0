"""Secret scans over a ledger of content-addressed blobs: each blob meets each version of a rule once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, leftmost and without overlap, and how long a group must be (0: the match)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds in the order of their listing.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of these letters that is long enough is one match from its start, so the length can be part of the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Formats that issuers publish; they add spans.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 1, r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,128}@"),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:bigint,place:int,kind:string,stop:bigint>>"
LEDGER = f"blob string, rule string, spans {SPAN}"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in code points. Splitting at the pattern gives the gaps between the matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    size = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    steps = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), size.alias("sized")),
                        lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"),
                                           (F.length(x["sized"]) >= rule.least).alias("good")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (begin + x["hit"]).alias("stop"))
        return F.struct((begin + x["hit"]).alias("at"), F.when(x["good"], F.concat(state["out"], F.array(span).cast(SPAN))).otherwise(state["out"]).alias("out"))
    spans = F.aggregate(steps, start, step, lambda s: s["out"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(F.array().cast(SPAN))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path",
         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger does not know; returns (findings of every row of ``versions``, ledger entries to add).

    ``versions``: every version of every file, one row each. A blob is named by the SHA-256 of its bytes; a blob that
    came before, under this or any other path, is not scanned again by a rule of the same version. A new
    version of a rule scans all blobs once more. ``ledger`` (LEDGER) holds one row for each blob and rule that met,
    findings or not; the caller appends the second table to it. Both are written once, so a retry adds nothing twice.

    Findings: path, blob, spans array<struct<start, place, kind, stop>>, by start, then rule order. Null text
    is empty. Repeated rows and null paths stay, one row out for each row in.
    """
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    new = rows.groupBy("blob").agg(F.first("text").alias("text"))
    keys = [r.key for r in rules]
    done = None
    if ledger is not None:
        done = ledger.where(F.col("rule").isin(*keys)).select("blob", "rule", "spans")
        known = done.groupBy("blob").agg(F.collect_set("rule").alias("known"))
        new = new.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        new = new.where(F.size(F.array_except(F.array(*map(F.lit, keys)), "known")) > 0)
    else:
        new = new.withColumn("known", F.array().cast("array<string>"))
    looked = [F.when(~F.array_contains("known", r.key), F.struct(F.lit(r.key).alias("rule"), _spans(F.col("text"), r, i).alias("spans")))
              for i, r in enumerate(rules)]
    entries = new.select("blob", F.explode(F.array_compact(F.array(*looked))).alias("e")).select("blob", "e.rule", "e.spans")
    entries = stored(entries, "ledger")
    every = entries if done is None else entries.unionByName(done)
    # one row for each blob with findings; the blobs without any need no partner
    by_blob = every.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = rows.select("path", "blob").join(by_blob, "blob", "left")
    return out.select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), entries


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
