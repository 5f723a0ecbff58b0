"""Ranked lexical search the other way round: an inverted index of the items' terms, documents streamed through it."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches

#: ASCII letters and digits and all bytes of other code points make terms; ``lower`` of bytes changes A-Z only.
TERM, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split into terms at once.
STEP = 1 << 22
#: (term, item) pairs of an index that goes to the tasks; more items are searched for block after block.
POSTINGS_MOST = 1_000_000
#: Lists of an item are merged in so many parts before they are merged as one.
PARTS = 64


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a text (UTF-8); in steps that end between terms, so a long text is never listed whole."""
    out, at = Counter(), 0
    text = text or b""
    while at < len(text):
        gap = GAP.search(text, min(at + STEP, len(text)))
        end = gap.start() if gap else len(text)
        out.update(TERM.findall(text[at:end].lower()))
        at = end
    return out


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Index:
    """Of a block of items: their ids, the place of each term, and the items that hold it."""

    items: list
    places: dict[bytes, int]
    holders: list[np.ndarray]


def _index(block: list[tuple[object, set[bytes]]]) -> Index:
    holders: dict[bytes, list[int]] = {}
    for k, (_, terms) in enumerate(block):
        for t in terms:
            holders.setdefault(t, []).append(k)
    listed = sorted(holders)
    return Index([i for i, _ in block], {t: k for k, t in enumerate(listed)}, [np.array(holders[t], np.int64) for t in listed])


def indexes(items: DataFrame, item: str, text: str, most: int = POSTINGS_MOST) -> Iterator[Index]:
    """Indexes over all items in blocks of at most ``most`` pairs (or one item). Rows of one id are one item; items without a term are left out.

    The items come to the driver one after the other; it holds one block.
    """
    rows = items.select(F.col(item).alias("i"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL").orderBy("i")
    block: list[tuple[object, set[bytes]]] = []
    pairs = 0
    for r in rows.toLocalIterator():
        terms = set(term_counts(bytes(r["t"])))
        if not terms:
            continue
        if block and block[-1][0] == r["i"]:
            pairs += len(terms - block[-1][1])
            block[-1][1].update(terms)
            continue
        if block and pairs + len(terms) > most:
            yield _index(block)
            block, pairs = [], 0
        block.append((r["i"], terms))
        pairs += len(terms)
    if block:
        yield _index(block)


def _statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, and the documents that hold each term of the index."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, n, total = index.value.places, Counter(), 0, 0
        for part in parts:
            for text in part.column("t").to_pylist():
                counts = term_counts(text)
                if counts:
                    n += 1
                    total += counts.total()
                    held.update(counts.keys() & places.keys())
        keys, values = [-2, -1, *map(places.__getitem__, held)], [n, total, *held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.int64())], ["k", "n"])
    found = docs.select("t").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = {r["k"]: r["n"] for r in found}
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(index.value.places))], np.int64)


class Heaps:
    """The best ``k`` (score, document) of each item; of equal scores the smaller id is better, no id is the worst."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)       # a score below it doesn't enter

    def offer(self, doc: int | None, scores: np.ndarray) -> None:
        rank = -(2**63) if doc is None else -doc
        for item in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.best[item], (int(scores[item]), rank)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = max(1, heap[0][0])

    def rows(self) -> list[tuple[int, int, int | None]]:
        return [(item, score, None if rank == -(2**63) else -rank) for item, heap in enumerate(self.best) for score, rank in heap]


def _best(docs: DataFrame, index, documents: int, total: int, weights: list[int], k: int) -> DataFrame:
    """The k best of each item among the documents of each task: item, score, doc."""
    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, holders = index.value.places, index.value.holders
        heaps = Heaps(len(index.value.items), k)
        for part in parts:
            for doc, text in zip(part.column("d").to_pylist(), part.column("t").to_pylist()):
                counts = term_counts(text)
                met = counts.keys() & places.keys()
                if not met:
                    continue
                m = 10 + 90 * counts.total() * documents // total
                at = [places[t] for t in met]
                gains = [weights[p] * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t, p in zip(met, at)]
                lists = [holders[p] for p in at]
                scores = np.zeros(len(heaps.best), np.int64)
                np.add.at(scores, np.concatenate(lists), np.repeat(np.array(gains, np.int64), [len(x) for x in lists]))
                heaps.offer(doc, scores)
        rows = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "score", "doc"])
    return docs.mapInArrow(search, "item int, score long, doc long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", most: int = POSTINGS_MOST) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score (all that score above 0 where they are fewer).

    Every whole text is read twice for each block of items: for the counts that the weights come from, then for the scores.
    Null or termless texts have no score and count nowhere. Repeated rows are documents of their own. A null doc_id ranks after
    any other of its score; a null item_id is an item. No documents or items: no rows. ``doc_id`` is an integer; other columns are left alone.

    A task keeps ``k`` entries an item, so no list grows with the documents; lists are merged by item and part, then by item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL")
    kind = items.schema[item_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = None
    for index in indexes(items, item_id, item_text, most):
        sent = spark.sparkContext.broadcast(index)
        documents, total, holding = _statistics(rows, sent)
        if not documents:
            break
        best = _best(rows, sent, documents, total, [weight(documents, int(h)) for h in holding], k)
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        for keys in (["item", "part"], ["item"]):
            best = best.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS))) if "part" in keys else best
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(index.items)), f"item int, item_id {kind}")
        found = best.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out
