"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches, stored

#: Runs of letters and digits, runs of other signs, and line ends are tokens.
TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
BLANK = re.compile(r"\s")
#: A token's bucket: its shape, and a hash of it among so many. The table of word vectors has one row for each bucket.
SHAPES, HASHES = 8, 2048
BUCKETS = SHAPES * HASHES
#: Components of the vectors, how many of an index vector are not 0, and how far a context reaches on either side.
WIDTH, NONZERO, REACH = 32, 4, 2
#: Of a document: mean, deviation and step of each component.
VECTOR = 3 * WIDTH
#: Code points that are split into tokens at once, and tokens that are worked on at once.
STEP, TOKENS = 1 << 20, 1 << 16
#: Tokens that a worker remembers the buckets of.
MEMO = 1 << 16
#: At most so many different training documents of each label come to the driver, as pooled vectors.
ROWS_EACH = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 64, 0.005, 1e-4


def _shape(token: str) -> int:
    if token[0].isalpha():
        if token.islower():
            return 0
        if token.isupper() and len(token) > 1:
            return 2
        return 1 if token[:1].isupper() and (len(token) == 1 or token[1:].islower()) else 3
    return 4 if token[0].isdigit() else 6 if token == "\n" else 5


class _Buckets(dict):
    """Token -> bucket; a memo that is emptied at MEMO entries and doesn't keep long tokens."""

    def __missing__(self, token: str) -> int:
        found = _shape(token) * HASHES + xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % HASHES
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[token] = found
        return found


_BUCKETS = _Buckets()


def _index_vectors() -> np.ndarray:
    """A sparse random vector of 1 and -1 for each bucket, and zeros for the place between texts."""
    rng = np.random.default_rng(20_261)
    out = np.zeros((BUCKETS + 1, WIDTH), np.int16)
    at = rng.random((BUCKETS, WIDTH)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out[:-1], at, rng.choice(np.array([-1, 1], np.int16), (BUCKETS, NONZERO)), axis=1)
    return out


INDEX = _index_vectors()


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's tokens, in pieces of about STEP code points that end at white space (or, without any, there)."""
    text, at = text or "", 0
    while at < len(text):
        end = min(at + STEP, len(text))
        blank = BLANK.search(text, end, end + STEP)
        end = blank.start() if blank else min(end + STEP, len(text))
        listed = TOKEN.findall(text, at, end)
        if listed:
            yield np.fromiter(map(_BUCKETS.__getitem__, listed), np.uint16, len(listed))
        at = end


def _gathered(texts: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Pieces of the texts with the places of their texts, some TOKENS at a time."""
    owners, found, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in pieces(text):
            owners.append(k)
            found.append(piece)
            size += len(piece)
            if size >= TOKENS:
                yield owners, found
                owners, found, size = [], [], 0
    if found:
        yield owners, found


def add_contexts(found: list[np.ndarray], sums: np.ndarray) -> None:
    """Add to each token's row of ``sums`` the index vectors of its neighbours in the same piece."""
    gap = np.full(REACH, BUCKETS, np.uint16)
    b = np.concatenate([gap, *[x for piece in found for x in (piece, gap)]])
    own = INDEX[b]
    near = np.zeros((len(b) - 2 * REACH, WIDTH), np.int16)
    for k in range(1, REACH + 1):
        near += own[REACH - k:len(b) - REACH - k] + own[REACH + k:len(b) - REACH + k]
    inner = b[REACH:len(b) - REACH]
    order = np.argsort(inner, kind="stable")
    rows, starts = np.unique(inner[order], return_index=True)
    sums[rows] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A vector for each bucket, from the contexts of all its tokens in all texts of ``docs``: its direction plus its own index vector.

    Tasks add up whole numbers, so neither the partitions nor lost tasks change a sum; a task sends one row for each bucket it met. The driver
    gets the table of BUCKETS rows, whatever the size of the corpus.
    """
    small_batches(docs.sparkSession)
    columns = [f"s{k}" for k in range(WIDTH)]

    def contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, met = np.zeros((BUCKETS + 1, WIDTH), np.int64), np.zeros(BUCKETS + 1, bool)
        for part in parts:
            for _, found in _gathered(part["t"]):
                add_contexts(found, sums)
                for piece in found:
                    met[piece] = True
        rows = np.flatnonzero(met[:-1])
        out = pd.DataFrame(sums[rows], columns=columns)
        out.insert(0, "bucket", rows.astype(np.int32))
        yield out
    sent = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInPandas(contexts, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    total = sent.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    sums = np.zeros((BUCKETS + 1, WIDTH), np.float64)
    sums[total["bucket"].to_numpy()] = total[columns].to_numpy()
    length = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
    vectors = sums / np.where(length > 0, length, 1) + INDEX / np.sqrt(NONZERO)
    vectors[-1] = 0
    return vectors.astype(np.float32)


def pooled(texts: pd.Series, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and the deviation of its tokens' vectors and the mean size of a step from one to the next, by component.

    Zeros without a token. Steps tell a text that goes on from one that repeats a word or alternates with a sign.
    """
    sums, counts, ends = np.zeros((len(texts), VECTOR)), np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        for piece in pieces(text):
            v = vectors[piece]
            step = v[1:] - v[:-1]
            sums[k] += np.concatenate([v.sum(axis=0), *(np.einsum("ij,ij->j", x, x) for x in (v, step))])
            counts[k] += len(v)
            ends[k] += 1                            # no step leaves a piece
    mean, square = (sums[:, k * WIDTH:(k + 1) * WIDTH] / np.maximum(counts, 1)[:, None] for k in range(2))
    step = sums[:, 2 * WIDTH:] / np.maximum(counts - ends, 1)[:, None]
    return np.hstack([mean, np.sqrt(np.maximum(square - mean ** 2, 0)), np.sqrt(step)]).astype(np.float32)


@dataclass
class Network:
    """Two layers over scaled inputs; the output is divided by the temperature before the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x.astype(np.float64)) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood of labels under logits."""
    return float(np.mean(np.logaddexp(0, z) - y * z))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss, by w1, b1, w2 and b2."""
    s = (x - net.centre) / net.scale
    h = np.tanh(s @ net.w1 + net.b1)
    g = (_logistic(h @ net.w2 + net.b2) - y) / len(y)
    back = np.outer(g, net.w2) * (1 - h * h)
    return [s.T @ back, back.sum(axis=0), h.T @ g, np.array(g.sum())]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on minibatches; every tenth row is held back, for the epoch that is kept and for the temperature.

    With no rows at all every score is a half; with one label only, the scores move towards it.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    x, y = x.astype(np.float64), y.astype(np.float64)
    if not len(y):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    order = rng.permutation(len(y))
    held, taught = (order[::10], np.setdiff1d(order, order[::10])) if len(y) >= 50 else (order, order)
    scale = x[taught].std(axis=0)
    net = Network(x[taught].mean(axis=0), np.where(scale > 1e-6, scale, 1.0), rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    kept, least, step = [p.copy() for p in params], np.inf, 0
    for _ in range(EPOCHS):
        turn = rng.permutation(taught)
        for at in range(0, len(turn), BATCH):
            rows, step = turn[at:at + BATCH], step + 1
            for k, g in enumerate(gradients(net, x[rows], y[rows])):
                g = g + DECAY * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
        now = loss(net.logits(x[held]), y[held])
        if now < least:
            least, kept = now, [p.copy() for p in params]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3])
    z = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: loss(z / t, y[held])))
    return net


def pooled_column(spark, vectors: np.ndarray):
    """A column function text -> pooled vector as 4-byte floats."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pool(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([v.tobytes() for v in pooled(texts, sent.value)])
    return pool


def train(vectors: DataFrame, labels: DataFrame, taught: Column, doc_id: str = "doc_id", label: str = "quality") -> Network:
    """Fit on rows of ``vectors(doc_id, v)`` for which ``taught`` holds and whose id has one label, 0 or 1.

    Null or contradictory labels teach nothing; equal vectors of one label are one example. The sample is bounded: of each label the first
    ROWS_EACH by a hash of the vector, all where there are fewer. Labels are joined to ids and hashes; the vectors of the sample are
    looked up by its hashes, of which there are at most 2 ROWS_EACH. Hashes are ranked below a level that half as many again as
    needed are expected under, so that the one task of a label never gets more than that.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select(doc_id, "y")
    hashed = vectors.where(taught).select(doc_id, F.xxhash64("v").alias("k"), "v")
    rows = hashed.select(doc_id, "k").join(marks, doc_id).select("y", "k").distinct()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}     # two rows
    level = F.lit(2.0 ** 63)
    for y, n in sizes.items():
        if n > 2 * ROWS_EACH:
            level = F.when(F.col("y") == y, 2.0 ** 63 * (3 * ROWS_EACH / n - 1)).otherwise(level)
    first = Window.partitionBy("y").orderBy("k")
    some = rows.where(F.col("k").cast("double") <= level).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ROWS_EACH)
    some = some.select("y", "k").toPandas()
    wanted = vectors.sparkSession.createDataFrame(pd.DataFrame({"k": some["k"].unique().astype(np.int64)}), "k long")
    found = hashed.join(F.broadcast(wanted), "k").groupBy("k").agg(F.first("v").alias("v")).toPandas()
    some = some.merge(found, on="k").sort_values(["y", "k"])
    x = np.array([np.frombuffer(v, np.float32) for v in some["v"]], np.float32).reshape(-1, VECTOR)
    return fit(x, some["y"].to_numpy())


def scorer(spark, net: Network):
    """A column function pooled vector -> score."""
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in parts:
            yield pd.Series(sent.value.scores(np.array([np.frombuffer(v, np.float32) for v in vs]).reshape(-1, VECTOR)))
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, taught: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, taught, score (0 to 1). ``taught`` tells by the id whose labels may be learned from.

    Word vectors come from all whole texts. Null or empty texts have the score of a vector of zeros; repeated rows and ties have equal
    scores; a null id has no label; other columns are left alone. Texts are read twice; what is stored is 96 floats a document.
    """
    spark = docs.sparkSession
    pool = pooled_column(spark, word_vectors(docs, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("doc_id", pool("t").alias("v"))
    rows = stored(rows, "pooled").withColumn("taught", taught)
    net = train(rows, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality")), F.col("taught"))
    return rows.select(F.col("doc_id").alias(doc_id), "taught", scorer(spark, net)("v").alias("score"))
