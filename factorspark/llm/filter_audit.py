"""Filter interaction audit: count-weighted decision diagrams of failure masks, reordered by adjacent level swaps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the filters: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The most filters a diagram takes: its cells are 2 ** k failure masks, its orders k!.
FILTERS_MOST = 8

Weight = tuple[int, ...]


def plain_changes(n: int) -> Iterator[int]:
    """Places of adjacent swaps that lead through all n! orders: the last element sweeps, the others change between sweeps."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    for k in range(math.factorial(n - 1)):
        down = k % 2 == 0
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        at = next(inner, None)
        if at is not None:
            yield at + 1 if down else at


class Diagram:
    """Counts of failure masks as a decision diagram: level k asks whether a document passes filter ``order[k]``.

    Equal subdiagrams are one node. A node weighs what its leaves weigh together, so the weight of a node on a path is the
    number of documents that take this path.
    """

    def __init__(self, filters: int, cells: Mapping[int, Weight], width: int) -> None:
        self.order = list(range(filters))
        self._known: dict[tuple, int] = {}
        self._kids: list[tuple[int, int]] = []
        self.weight: list[Weight] = []
        none = (0,) * width
        row = [self._leaf(tuple(cells.get(mask, none))) for mask in range(1 << filters)]
        for f in reversed(range(filters)):      # masks of the filters 0..f, the last one failing in the upper half
            half = 1 << f
            row = [self._node(f, row[m], row[m + half]) for m in range(half)]
        self.root = row[0]

    def _leaf(self, weight: Weight) -> int:
        return self._kept(("leaf", weight), (-1, -1), weight)

    def _node(self, f: int, passes: int, fails: int) -> int:
        return self._kept((f, passes, fails), (passes, fails), tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails])))

    def _kept(self, key: tuple, kids: tuple[int, int], weight: Weight) -> int:
        if key not in self._known:
            self._known[key] = len(self._kids)
            self._kids.append(kids)
            self.weight.append(weight)
        return self._known[key]

    def swap(self, at: int) -> None:
        """Exchange the levels ``at`` and ``at + 1``: the two middle grandchildren of each node there change places."""
        x, y = self.order[at:at + 2]
        done: dict[int, int] = {}

        def redone(node: int, level: int) -> int:
            if node not in done:
                passes, fails = self._kids[node]
                if level < at:
                    done[node] = self._node(self.order[level], redone(passes, level + 1), redone(fails, level + 1))
                else:
                    (pp, pf), (fp, ff) = self._kids[passes], self._kids[fails]
                    done[node] = self._node(y, self._node(x, pp, fp), self._node(x, pf, ff))
            return done[node]
        self.root = redone(self.root, 0)
        self.order[at:at + 2] = [y, x]

    def all_pass_path(self) -> list[tuple[Weight, Weight]]:
        """For each level of the order: the weights of what passes it and of what fails it, having passed all before."""
        out, node = [], self.root
        for _ in self.order:
            passes, fails = self._kids[node]
            out.append((self.weight[passes], self.weight[fails]))
            node = passes
        return out


def order_steps(cells: Mapping[int, Weight], names: Sequence[str], weights: int) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, *lost, shapley) of all orders of the filters.

    The first weight of a cell is its number of documents, the others what is to be counted among the removed. A filter
    that stands first removes all that fail it, one that stands last only what fails no other.
    """
    d = Diagram(len(names), cells, weights)
    paths = [(tuple(d.order), d.all_pass_path())]
    for at in plain_changes(len(names)):
        d.swap(at)
        paths.append((tuple(d.order), d.all_pass_path()))
    fails, alone, shapley = {}, {}, dict.fromkeys(range(len(names)), 0)
    for order, path in paths:
        fails[order[0]], alone[order[-1]] = path[0][1][0], path[-1][1][0]
        for f, (_, lost) in zip(order, path):
            shapley[f] += lost[0]
    return [("".join(names[f] for f in order), step, kept[0], lost[0], fails[f] - lost[0], alone[f], *lost[1:], shapley[f])
            for order, path in paths for step, (f, (kept, lost)) in enumerate(zip(order, path), 1)]


def corpus_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of the filters that a text alone decides; no word at all fails only A."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    return {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * chars, "D": text.rlike("[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts of failure masks: part, mask, n, good, toxic. Bit k of a mask is the k-th filter; the last bit is a copy.

    ``docs(doc_id, text, lang)``, ``labels(doc_id, quality, toxic)``; other columns are left alone. A null text is empty, a null
    lang the part of the empty string. A copy is a row whose text some smaller doc_id has in any part; a row without an id is none and
    makes none, repeated rows of one id aren't copies of each other. Texts are the same if their SHA-256 is. Where an id has several
    labels, it is good (toxic) if one of them says so; a row of documents counts as often as it is there.

    Texts stay in the scan: only (id, digest, part, mask) are shuffled, first by id to the labels, then, summed on the way, by digest.
    A text that a third of the rows share is a few rows by then (one for each part, mask and label).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    filters = corpus_filters(text) if filters is None else filters
    if len(filters) >= FILTERS_MOST:
        raise ValueError(f"at most {FILTERS_MOST - 1} filters beside the one for copies")
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), mask.alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    per_id = rows.groupBy("doc_id", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))
    same = per_id.groupBy("digest", *kind).agg(
        F.min("doc_id").alias("least"), F.sum("n").alias("n"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = same.groupBy("digest").agg(F.min("least").alias("first"))
    same = same.join(first, "digest")
    # of a cell, the rows of the first id and those without an id are originals
    kept = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    same = same.withColumn("both", F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")),
                                           F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - kept).alias("n"))))
    cells = same.select("part", "good", "toxic", F.inline("both"))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interaction_audit(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """All orders of the filters over each part of ``cells(part, mask, n, good, toxic)``: one row for each order and step.

    A part is one group of at most 2 ** k rows, whatever its number of documents. No cells, no rows.
    """
    if not 1 <= len(names) <= FILTERS_MOST:
        raise ValueError(f"from 1 to {FILTERS_MOST} filters")
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    names = list(names)

    def steps(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(n), int(g), int(t)) for m, n, g, t in part[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(order_steps(found, names, 3), columns=columns)
        out.insert(0, "part", key[0])
        return out
    longs = ", ".join(f"{c} long" for c in columns[2:])
    return cells.groupBy("part").applyInPandas(steps, f"part string, filter_order string, step int, {longs}")
