"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches

#: Buckets and width of the embeddings, and the lengths of the character sequences that are hashed into them.
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
#: At most so many training documents of each language come to the driver; windows of them are the examples.
ROWS_EACH, WINDOWS, WINDOW = 800, 4, 160
EPOCHS, RATE, PRECISION = 3, 0.5, 0.99
UNKNOWN = "und"
#: Letters and the marks that combine with them; other numerals, such as fractions and superscripts, are none.
_LETTER = regex.compile(r"\p{L}")
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Lower-case letters with their marks, all else one space; no letter (marks alone are none): empty."""
    clean = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    return clean if _LETTER.search(clean) else ""


def buckets(clean: str) -> Iterator[np.ndarray]:
    """Buckets of the character sequences of each length, with a space at both ends."""
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ points[n - 1:]
        if n in GRAMS:
            yield ((h * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray          # of each bucket: its embedding times the output weights
    bias: np.ndarray
    warmth: float               # the logits are divided by it
    least: float                # predictions with a lower score are rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        clean = letters(text)
        if not clean or not self.languages:
            return UNKNOWN, 0.0, False
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets(clean):
            for at in range(0, len(b), 1 << 16):        # whole texts, in bounded steps
                total += self.logits[b[at:at + (1 << 16)]].sum(axis=0)
            n += len(b)
        p = _softmax((total / n + self.bias) / self.warmth)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Stochastic gradient descent on windows of the texts; a tenth of the texts sets warmth and rejection."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    examples, held = [], []
    for k in rng.permutation(len(texts)):
        clean, y = letters(texts[k]), languages.index(langs[k])
        if not clean:
            continue
        for _ in range(WINDOWS):
            start = int(rng.integers(max(1, len(clean) - WINDOW)))
            x = np.concatenate(list(buckets(clean[start:start + int(rng.integers(12, WINDOW))] or clean)))
            (held if k % 10 == 0 and len(texts) >= 50 else examples).append((x, y))
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * max(len(examples), 1), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            x, y = examples[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            h = emb[x].mean(axis=0)
            g = _softmax(h @ out + bias)
            g[y] -= 1
            back = (out @ g) * (rate * 8 / len(x))      # the mean spreads a step thinly over its buckets
            out -= rate * np.outer(h, g)
            bias -= rate * g * np.float32(0.1)
            np.subtract.at(emb, x, back)
    logits = (emb @ out).astype(np.float32)
    checked = held or examples
    z = np.array([logits[x].mean(axis=0) + bias for x, _ in checked])
    y = np.array([t for _, t in checked])
    losses = {w: -np.log(_softmax(z / w)[np.arange(len(y)), y] + 1e-12).mean() for w in np.geomspace(0.1, 10, 41)} if len(y) else {1.0: 0}
    warmth = float(min(losses, key=losses.get))
    least = 0.0
    if len(y):
        p = _softmax(z / warmth)
        order = np.argsort(-p.max(axis=1))
        right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= PRECISION)
        least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return Model(languages, logits, bias, warmth, least)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None) -> Model:
    """Fit on a bounded sample: of each language the first ROWS_EACH different texts by a hash (or different values of ``key``), all where there are fewer.

    Rows without a language or a text teach nothing; repeated rows are one. Texts that many rows share neither crowd the sample nor leave it,
    and only the sample comes to the driver. Hashes are ranked below a level that half as many again as needed are expected under.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), (F.xxhash64(text) if key is None else F.xxhash64(key)).alias("k"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    hashes = rows.select("lang", "k").distinct()
    sizes = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}       # one row for each language
    if not sizes:
        return fit([], [])
    level = F.lit(2.0 ** 63)
    for name, n in sizes.items():
        if n > 2 * ROWS_EACH:
            level = F.when(F.col("lang") == name, 2.0 ** 63 * (3 * ROWS_EACH / n - 1)).otherwise(level)
    first = Window.partitionBy("lang").orderBy("k")
    wanted = hashes.where(F.col("k").cast("double") <= level).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ROWS_EACH)
    listed = docs.sparkSession.createDataFrame([(r["lang"], r["k"]) for r in wanted.select("lang", "k").collect()], "lang string, k long")
    # at most ROWS_EACH hashes of each language
    some = rows.join(F.broadcast(listed), ["lang", "k"]).groupBy("lang", "k").agg(F.first("text").alias("text")).toPandas().sort_values(["lang", "text"])
    return fit(some["text"].to_list(), some["lang"].to_list())


def identifier(spark, model: Model):
    """A column function text -> struct<lang, score, accepted>; null or letterless: und, 0, not accepted.

    ``lang`` is the likeliest learned language even where it isn't ``accepted``: where the calibrated score is below
    the level at which 99 percent of the held-back predictions were right.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([sent.value.predict(x) for x in texts], columns=["lang", "score", "accepted"])
    return identify
