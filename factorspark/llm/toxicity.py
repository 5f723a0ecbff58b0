"""Toxicity by class-conditional Kneser-Ney models of words and word pairs with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import WordCodes, alone, discard, small_batches, stored

#: The most frequent words go to the tasks with their counts, so that no word with many pairs lands in one bucket.
#: All other words, and all pairs, are counted and looked up in buckets; nothing is left out.
WORDS_MOST = 262_144
#: Words of text for each bucket, and the least number of buckets.
BUCKET_WORDS, BUCKETS_LEAST = 4_000_000, 12
#: Labelled documents that place the score on the scale of 0 to 1.
CALIBRATION_ROWS = 20_000
CHUNK = 2_000_000
#: Shared backoff count of an expression, in texts.
BACKOFF = 3.0
#: The ratios are also summed over the words whose ratio is at least so strong, either way: a few strong
#: expressions in a long ordinary text would drown in the sum over all words.
TIERS = (0.0, 1.0, 2.0)
FEATURES = 4 * len(TIERS)
_CODES = WordCodes()


def _words(text: str | None) -> np.ndarray:
    listed = (text or "").split()
    codes = np.fromiter(map(alone(_CODES).__getitem__, listed), np.int64, len(listed))
    return codes[codes > 0]


def _counted(keys: list[np.ndarray], toxic: list[bool]) -> pd.DataFrame:
    every = np.concatenate(keys)
    label = np.repeat(np.array(toxic, np.int64), [len(k) for k in keys])
    found, at = np.unique(every, return_inverse=True)
    bad = np.bincount(at, label, len(found)).astype(np.int64)
    return pd.DataFrame({"key": found, "t": bad, "o": np.bincount(at, minlength=len(found)) - bad})


def _counter(keys_of):
    """Per task: in how many texts of each class a key stands, summed over a bounded chunk of texts before they leave."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, toxic, held = [], [], 0
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                k = np.unique(keys_of(text))
                keys.append(k)
                toxic.append(bool(label))
                held += len(k)
                if held >= CHUNK:
                    yield _counted(keys, toxic)
                    keys, toxic, held = [], [], 0
        if held:
            yield _counted(keys, toxic)
    return count


@dataclass
class Vocabulary:
    codes: np.ndarray           # sorted word codes
    toxic: np.ndarray           # counts in toxic and ordinary texts
    ordinary: np.ndarray
    order: np.ndarray | None = None     # where each word's counts stand, if not in the order of the codes

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Index of each word's counts, -1 if it isn't listed here."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at if self.order is None else self.order[at], -1)


#: Ids of listed words lie below LISTED, those of other words above OTHER.
LISTED, OTHER = 1 << 20, 1 << 62
_TOP = np.uint64(1 << 63)


def _ids(codes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The id of each word: its place in the list from 1 on, or its code."""
    at = vocabulary.places(codes)
    return np.where(at >= 0, at + 1, codes | OTHER)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _keys(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One number for each (history, word), that of two listed words made of their ids; history 0: the word alone."""
    near = (histories < LISTED) & (histories > 0) & (words < LISTED)
    return np.where(near, ((words << 20) | histories).astype(np.uint64), _mixed(histories, words) | _TOP)


def _buckets(keys: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """A listed word's pairs lie in any bucket, all of another word in one."""
    by = np.where(words < LISTED, _mixed(keys, keys >> np.uint64(7)), _mixed(words, words))
    return ((by >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _cut(by: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket that has any, in order."""
    order = np.argsort(by, kind="stable")
    ends = np.searchsorted(by[order], np.arange(buckets + 1))
    for k in range(buckets):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k]:ends[k + 1]]


def _packed(keys: np.ndarray, *rest: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first in ascending order, by steps and byte places, compressed."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, *rest)]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True) if len(keys) else b""


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    if not blob:
        return [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * (columns - 1)]
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n * columns, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    steps, *rest = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in planes]
    return [np.cumsum(steps, dtype=np.uint64), *[x.view(np.int64) for x in rest]]


COUNTS = "bucket int, near binary, far binary"


def _summed(keys: np.ndarray, words: np.ndarray, before: np.ndarray, t: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    found, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return [found, words[first], before[first], *[np.bincount(at, x, len(found)).astype(np.int64) for x in (t, o)]]


def _write_counts(bucket: int, keys: np.ndarray, words: np.ndarray, before: np.ndarray, t: np.ndarray, o: np.ndarray) -> dict:
    """The key of two listed words tells both; other keys are made again of the word, by whose id they lie, and its history."""
    near, far = np.flatnonzero(keys < _TOP), np.flatnonzero(keys >= _TOP)
    far = far[np.lexsort((before[far], np.abs(words[far])))]
    return {"bucket": bucket, "near": _packed(keys[near], t[near], o[near]), "far": _packed(np.abs(words[far]), before[far], t[far], o[far])}


def _read_counts(near: Iterable[bytes], far: Iterable[bytes]) -> list[np.ndarray]:
    """Keys in ascending order, words (minus its id where a word stands alone), their histories and counts by class."""
    keys, *counts = [np.concatenate(x) for x in zip(_unpacked(b"", 3), *[_unpacked(b, 3) for b in near])]
    words, before, *others = [np.concatenate(x) for x in zip(_unpacked(b"", 4), *[_unpacked(b, 4) for b in far])]
    words = words.astype(np.int64)
    every = [np.concatenate([keys, _keys(before, words)]), np.concatenate([(keys >> np.uint64(20)).astype(np.int64), np.where(before == 0, -words, words)]),
             np.concatenate([(keys & np.uint64(LISTED - 1)).astype(np.int64), before]), *[np.concatenate(x) for x in zip(counts, others)]]
    order = np.argsort(every[0], kind="stable")
    return [x[order] for x in every]


def _pair_counter(sent, buckets: int):
    """Per task: in how many texts of each class a pair stands, and a word that isn't listed."""
    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> pd.DataFrame:
        bad = np.repeat(np.array([p[3] for p in parts], np.int64), [len(p[0]) for p in parts])
        columns = _summed(*[np.concatenate([p[k] for p in parts]) for k in range(3)], bad, 1 - bad)
        by = _buckets(columns[0], np.abs(columns[1]), buckets)
        return pd.DataFrame([_write_counts(k, *[x[at] for x in columns]) for k, at in _cut(by, buckets)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                ids = _ids(_words(text), sent.value)
                if not len(ids):
                    continue
                rare = np.unique(ids)
                rare = rare[rare >= LISTED]
                keys = np.concatenate([_keys(ids[:-1], ids[1:]), _keys(np.zeros_like(rare), rare)])
                words, before = np.concatenate([ids[1:], -rare]), np.concatenate([ids[:-1], np.zeros_like(rare)])
                keys, first = np.unique(keys, return_index=True)
                if len(keys):
                    parts.append((keys, words[first], before[first], bool(label)))
                    held += len(keys)
                if held >= CHUNK:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)
    return count


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_write_counts(int(rows["bucket"].iloc[0]), *_summed(*_read_counts(rows["near"], rows["far"])))])


def _histories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pairs each listed word has (by place), and how many pairs stand in one text (-1) and in two (-2)."""
    for batch in batches:
        for near, far in zip(batch["near"], batch["far"]):
            _, words, _, t, o = _read_counts([near], [far])
            place, n = np.unique(words[(words > 0) & (words < LISTED)] - 1, return_counts=True)
            for k in (1, 2):
                place, n = np.append(place, -k), np.append(n, ((words > 0) & (t + o == k)).sum())
            yield pd.DataFrame({"place": place, "n": n})


def _listed(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The most frequent keys, ``most`` at most: those above a count that a histogram of counts gives."""
    sizes = counts.groupBy(F.least(F.col("t") + F.col("o"), F.lit(100_000)).alias("c")).count().toPandas().sort_values("c", ascending=False)
    fits = sizes[sizes["count"].cumsum() <= most]
    least = int(fits["c"].min()) if len(fits) else int(sizes["c"].max() if len(sizes) else 0) + 1
    return counts.where(F.col("t") + F.col("o") >= least), least


@dataclass
class Rates:
    """What places evidence: counts are of texts.

    A word's probability in a class is its discounted rate there plus what it gets from the backoff counts that both
    classes share; a pair's is its discounted rate plus the shared backoff count times the class's own tilt of the
    word. So a word or pair that neither class has seen, or only once by chance, is little evidence, and the size of
    a class none. ``own``: 1 or 0, the class of a text that was counted, whose own counts are taken off first, so
    that it is scored as a text that the model hasn't seen; -1 for any other text.
    """

    discount: float
    sizes: tuple[float, float]  # toxic and ordinary texts

    def words(self, t, o, histories, own) -> tuple[np.ndarray, np.ndarray]:
        nt, no = self.sizes
        shared = BACKOFF * (1 + np.log1p(histories)) / (nt + no)
        return np.maximum(t - (own == 1) - self.discount, 0) / nt + shared, np.maximum(o - (own == 0) - self.discount, 0) / no + shared

    def pairs(self, t, o, p_t, p_o, own) -> np.ndarray:
        nt, no = self.sizes
        back = BACKOFF / (nt * p_t + no * p_o)
        return np.log((np.maximum(t - (own == 1) - self.discount, 0) / nt + back * p_t) / (np.maximum(o - (own == 0) - self.discount, 0) / no + back * p_o))


def _tiers(ratios: np.ndarray) -> np.ndarray:
    return np.stack([np.where(np.abs(ratios) >= tier, ratios, 0.0) for tier in TIERS])


def _per_text(doc: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(doc, v, size) for v in values])


@dataclass
class Model:
    words: Vocabulary           # the listed words
    histories: np.ndarray       # and their distinct histories in both classes
    rates: Rates
    counts: DataFrame           # counts of all pairs and of the other words, one row for each bucket
    buckets: int
    scale: np.ndarray           # intercept and weights of the score
    sent: Broadcast | None = None       # the listed words and histories in the tasks, sent once


ASKED = "bucket int, chunk bigint, salt int, listed binary, others binary, own binary, ids array<string>, sums binary"
PARTIAL = "bucket int, chunk bigint, docs binary, parts binary, ids array<string>, sums binary"


def _grown(batches: Iterator[pd.DataFrame], rows: int = 1024, letters: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Batches joined up to so many rows or letters: texts that ask together name a key once."""
    held, n, size = [], 0, 0
    for batch in batches:
        long = sum(map(len, filter(None, batch["text"])))
        if held and (n + len(batch) > rows or size + long > letters):
            yield pd.concat(held, ignore_index=True)
            held, n, size = [], 0, 0
        held.append(batch)
        n, size = n + len(batch), size + long
    if held:
        yield pd.concat(held, ignore_index=True)


def _asker(sent, rates: Rates, buckets: int, salts: int):
    """Batches of texts -> what they ask of each bucket, and the sums over their listed words."""
    def entries(words: np.ndarray, before: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """Keys, words, their histories, texts and how often each stands there, by word and key."""
        keys = _keys(before, words)
        order = np.lexsort((doc, keys, words)) if (words >= LISTED).any() else np.lexsort((doc, keys))
        k, d = keys[order], doc[order]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.empty(0, np.int64)
        return [k[first], words[order][first], before[order][first], d[first], np.diff(np.append(first, len(k)))]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, histories = sent.value
        chunk = TaskContext.get().partitionId() << 33
        for batch in _grown(batches):
            texts = [_words(x) for x in batch["text"]]
            sizes = np.array([len(x) for x in texts], np.int64)
            ids = _ids(np.concatenate([np.empty(0, np.int64), *texts]), vocabulary)
            doc = np.repeat(np.arange(len(texts)), sizes)
            before = np.append(0, ids[:-1])[:len(ids)]
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
            here = ids < LISTED
            at = ids[here] - 1
            own = batch["own"].to_numpy(np.int8)
            p_t, p_o = rates.words(vocabulary.toxic[at], vocabulary.ordinary[at], histories[at], own[doc[here]])
            sums = np.vstack([sizes, _per_text(doc[here], _tiers(np.log(p_t / p_o)), len(texts))]).astype(np.float32)
            pairs = here & (before != 0)
            listed, others = [entries(ids[x], before[x], doc[x]) for x in (pairs, ~here)]
            a, b = [dict(_cut(_buckets(x[0], x[1], buckets), buckets)) for x in (listed, others)]
            home, none = chunk % 1_000_003 % buckets, np.empty(0, np.int64)
            yield pd.DataFrame([{
                "bucket": k, "chunk": chunk, "salt": chunk % 1_000_003 % salts, "listed": _packed(*[x[a.get(k, none)] for x in (listed[0], *listed[3:])]),
                "others": _packed(*[x[b.get(k, none)] for x in others[1:]]), "own": own.tobytes(), "ids": list(batch["row"]) if k == home else None,
                "sums": sums.tobytes() if k == home else None} for k in sorted({*a, *b, home})])
            chunk += 1
    return ask


def _answerer(sent, rates: Rates):
    """A bucket's counts and what is asked of it -> sums for each text: of other words, and of pairs in place of their words."""
    def answer(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vocabulary, histories = sent.value
        keys, words, _, t, o = _read_counts(counts["near"], counts["far"])
        alone = np.flatnonzero(words < 0)
        alone = alone[np.argsort(-words[alone])]
        rare = Vocabulary(-words[alone], t[alone], o[alone])
        place = rare.places(words[words >= LISTED])
        rare_histories = np.bincount(place[place >= 0], minlength=len(alone))

        def pair(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero((keys[i] == key) & (words[i] > 0))
            return hit, i[hit]
        out = []
        for row in asked.itertuples():
            own = np.frombuffer(row.own, np.int8)
            sums = np.zeros((2 * len(TIERS), len(own)))
            key, doc, n = _unpacked(row.listed, 3)
            hit, i = pair(key)
            doc, n, at = doc[hit], n[hit], words[i] - 1
            p_t, p_o = rates.words(vocabulary.toxic[at], vocabulary.ordinary[at], histories[at], own[doc])
            sums[len(TIERS):] += _per_text(doc, n * (_tiers(rates.pairs(t[i], o[i], p_t, p_o, own[doc])) - _tiers(np.log(p_t / p_o))), len(own))
            word, before, doc, n = _unpacked(row.others, 4)
            word = word.astype(np.int64)
            key, at = _keys(before, word), rare.places(word)
            known = at >= 0
            key, doc, n, at = key[known], doc[known], n[known], at[known]
            p_t, p_o = rates.words(rare.toxic[at], rare.ordinary[at], rare_histories[at], own[doc])
            single = np.log(p_t / p_o)
            both = single.copy()
            hit, i = pair(key)
            both[hit] = rates.pairs(t[i], o[i], p_t[hit], p_o[hit], own[doc[hit]])
            sums += _per_text(doc, n * np.vstack([_tiers(single), _tiers(both)]), len(own))
            some = np.flatnonzero(sums.any(axis=0))
            out.append({"bucket": row.bucket, "chunk": row.chunk, "docs": some.astype(np.int16).tobytes(),
                        "parts": sums[:, some].astype(np.float32).tobytes(), "ids": row.ids, "sums": row.sums})
        return pd.DataFrame(out, columns=["bucket", "chunk", "docs", "parts", "ids", "sums"])
    return answer


def _features(rows: pd.DataFrame) -> pd.DataFrame:
    """Log-likelihood ratios by length, of words and of words after their history: for each word and each root of a word."""
    home = rows[rows["ids"].notna()].iloc[0]
    size = len(home["ids"])
    whole = np.frombuffer(home["sums"], np.float32).reshape(-1, size).astype(float)
    sums = np.vstack([whole[1:], whole[1:]])
    for row in rows.sort_values("bucket").itertuples():
        docs = np.frombuffer(row.docs, np.int16)
        sums[:, docs] += np.frombuffer(row.parts, np.float32).reshape(len(sums), len(docs))
    n = np.maximum(whole[0], 1)
    return pd.DataFrame({"row": list(home["ids"]), "x": list(np.stack([sums / n, sums / np.sqrt(n)], axis=1).reshape(FEATURES, -1).T)})


def features(texts: DataFrame, model: Model) -> DataFrame:
    """row, x: the features of each text of ``texts`` (row: whatever stands for the row, unique or not, text, own: see Rates).

    The pairs and other words of a batch of texts meet the counts in their buckets, and only sums for each text come back.
    """
    spark = texts.sparkSession
    small_batches(spark)
    if model.sent is None:
        model.sent = spark.sparkContext.broadcast((model.words, model.histories))
    sent = model.sent
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    salts = max(1, -(-size // (6 * 2 * BUCKET_WORDS * model.buckets)))
    asked = texts.select(F.col("row").cast("string").alias("row"), "text", F.col("own").cast("tinyint").alias("own"))
    asked = asked.mapInPandas(_asker(sent, model.rates, model.buckets, salts), ASKED)
    counts = model.counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = counts.groupBy("bucket", "salt").cogroup(asked.groupBy("bucket", "salt")).applyInPandas(_answerer(sent, model.rates), PARTIAL)
    out = parts.groupBy("chunk").applyInPandas(_features, "row string, x array<double>")
    return out.select(F.col("row").cast(texts.schema["row"].dataType).alias("row"), "x")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve by Newton steps; a ridge on all but the intercept, in units of each column's spread."""
    spread = x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.concatenate([[1.0], spread])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Count words and word pairs of all labelled texts by class, and place the score on a scale.

    ``docs`` and ``labels`` (id, 0 or 1) meet by id; rows without an id, a label or a text teach nothing, and a
    document with several labels is toxic if one says so, and equal texts teach once. All words and pairs of every labelled text are counted and kept;
    the listed words and the calibration rows are bounded by the parameters above. Without both classes every score is 0.5 or less.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # copies teach once, with the label of most of them
    # labels grow with the documents: never a broadcast, at any size
    taught = rows.join(marks.hint("merge"), "id").groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.min("id").alias("id"))
    taught = stored(taught, "taught")
    words = stored(taught.select("text", "toxic").mapInPandas(_counter(_words), "key bigint, t bigint, o bigint").groupBy("key").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")), "words")
    listed = _listed(words, WORDS_MOST)[0].toPandas()
    discard(words)
    # frequent words have small ids, so the keys that are sent lie close together and take less room
    listed = listed.iloc[np.lexsort((listed["key"], -(listed["t"] + listed["o"])))]
    codes = listed["key"].to_numpy(np.int64)
    order = np.argsort(codes)
    vocabulary = Vocabulary(codes[order], listed["t"].to_numpy(np.int64), listed["o"].to_numpy(np.int64), order)
    sent = spark.sparkContext.broadcast(vocabulary)
    n, length, nt, no = taught.agg(F.count("*"), F.sum(F.length("text")), F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    buckets = max(BUCKETS_LEAST, -(-(length or 0) // (6 * BUCKET_WORDS)))
    counts = taught.select("text", "toxic").mapInPandas(_pair_counter(sent, buckets), COUNTS)
    counts = stored(counts.groupBy("bucket").applyInPandas(_merged, COUNTS), "counts")
    sent.destroy()
    found = counts.mapInPandas(_histories, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    seen = dict(zip(found["place"], found["n"]))
    once, twice = seen.pop(-1, 0), seen.pop(-2, 0)
    histories = np.zeros(len(vocabulary.codes))
    histories[np.fromiter(seen.keys(), np.int64, len(seen))] = np.fromiter(seen.values(), float, len(seen))
    discount = float(np.clip(once / max(once + 2 * twice, 1), 0.5, 0.95))
    model = Model(vocabulary, histories, Rates(discount, (max(nt, 1), max(no, 1))), counts, buckets, np.array([-3.0] + [0.0] * FEATURES))
    some = taught.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, CALIBRATION_ROWS / max(n, 1))))
    known = stored(features(some.select(F.col("toxic").alias("row"), "text", F.col("toxic").alias("own")), model), "known")
    discard(taught)
    known = known.toPandas()
    if known["row"].nunique() == 2:
        model.scale = _logistic(np.array(known["x"].to_list()), known["row"].to_numpy(float))
    return model


def scores(docs: DataFrame, model: Model, row: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` and score of each row of ``docs``; null and empty texts have a score too, and a row is judged by its text alone."""
    total = F.lit(float(model.scale[0]))
    for k, weight in enumerate(model.scale[1:]):
        total = total + F.lit(float(weight)) * F.get("x", F.lit(k))
    total = F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))
    asked = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("text"), F.lit(-1).alias("own"))
    return features(asked, model).select(F.col("row").alias(row), (1 / (1 + F.exp(-total))).alias("score"))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns; a row is judged by its text alone."""
    row = "number of the row"
    while row in docs.columns:
        row += "'"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    toxic = stored(scores(numbered, model, row, text).where(F.col("score") >= threshold).select(row), "toxic")
    return numbered.join(toxic, row, "left_anti").drop(row)
