"""MinHash near duplicates with tensored bands, exact confirmation and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import alone, discard, small_batches, stored

#: Collections of hashes, and minhashes in each. A table key combines two collections, so 48 minhashes make 120
#: keys of 6. At a similarity of 0.8 a collection agrees with p = 0.8 ** 3; a pair is missed when fewer than two of the
#: 16 agree: (1 - p) ** 16 + 16 p (1 - p) ** 15 = 1.8e-4, and 2e-9 at 0.95.
COLLECTIONS, EACH = 16, 3
#: Nodes that all others of a larger bucket meet before its remaining pairs are looked at.
PIVOTS = 32
#: The pair of collections of each table.
TABLES = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(1, 2**63, COLLECTIONS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COLLECTIONS * EACH, dtype=np.uint64)
_MIX, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Codes(dict):
    """Word in bytes -> 64-bit hash; a memo that is emptied at 400,000 entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ROLL
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words.

    A-Z count as a-z, words lie between ASCII white space (both are what bytes do). A text of fewer words is one
    shingle, one without words none.
    """
    listed = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not listed:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(alone(_CODES).__getitem__, listed), np.uint64, len(listed))
    width = min(words, len(codes))
    rows = len(codes) - width + 1
    rolled = np.full(rows, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _MIX + codes[k:k + rows])
    return np.unique(rolled)


def collections(shingles: np.ndarray) -> np.ndarray:
    """The hash of each collection of minhashes."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k:k + 4096][None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    out = np.zeros(COLLECTIONS, np.uint64)
    for k in range(EACH):
        out = _mixed(out * _MIX + least[k::EACH])
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """1024 bits: whether an odd number of the shingles has each ending. Where the bits of two sets differ, the sets do, so
    the number of differing bits is a lower bound of the number of shingles that only one of them has."""
    odd = np.bincount((shingles & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signature(words: int):
    @F.pandas_udf("n bigint, mark binary, u array<bigint>")
    def signature(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                s = shingle_set(text, words)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), _signed(collections(s))) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n", "mark", "u"])
    return signature.asNondeterministic()       # never evaluated twice for a filter on its result


def _shingles(words: int):
    @F.pandas_udf("mark binary, bits array<bigint>, held array<bigint>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingle_set(text, words) for text in texts]
            yield pd.DataFrame({"mark": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bits": [parities(s) for s in sets],
                                "held": [_signed(s) for s in sets]})
    return shingles.asNondeterministic()


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, tab, key): a key of each node for each pair of collections; ``tab`` is the number of the table."""
    tables = F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(i).alias("i"), F.lit(j).alias("j")) for t, (i, j) in enumerate(TABLES)])
    rows = nodes.select("node", "u", F.explode(tables).alias("at"))
    return rows.select("node", "at.tab", F.xxhash64("at.tab", F.get("u", F.col("at.i")), F.get("u", F.col("at.j"))).alias("key"))


def _first_table(u: Column, v: Column) -> Column:
    """The first table in which two nodes share a key: that of the first two collections on which they agree."""
    agree = F.filter(F.sequence(F.lit(0), F.lit(COLLECTIONS - 1)), lambda i: F.get(u, i) == F.get(v, i))
    i, j = F.get(agree, F.lit(0)), F.get(agree, F.lit(1))
    return (i * (2 * COLLECTIONS - i - 1) / 2 + j - i - 1).cast("int")


def _spread(rows: DataFrame) -> DataFrame:
    """(key, tab, node) -> one key of each distinct set of two or more nodes, with its least node: key, lo, hi, n.

    Groups of copies meet under many keys; the same set of nodes need not be looked at twice. The key of the
    first table stays, so the first table that two nodes share is always among those that stay.
    """
    met = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"),
                                  F.bit_xor(F.xxhash64("node")).alias("who"), F.min("tab").alias("tab")).where("n > 1")
    return met.groupBy("lo", "hi", "n", "who").agg(F.min_by("key", "tab").alias("key"))


def _can_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes may be linked, by what is known without their sets: sizes n, shingles m that others have too, parities.

    All bounds are exact, so a pair that fails has no link.
    """
    apart = sum((F.bit_count(F.get(f"bits{a}", F.lit(k)).bitwiseXOR(F.get(f"bits{b}", F.lit(k)))) for k in range(16)), F.lit(0))
    both = F.col(f"n{a}") + F.col(f"n{b}")
    common = F.least(f"m{a}", f"m{b}", F.floor((both - apart) / 2))
    return common * 100 >= (both - common) * percent


def _profile(sets: DataFrame, suffix: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{c}{suffix}") for c in ("node", "n", "m", "u", "bits")])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows of ``pairs`` (lo, node and more) that are linked, by their full sets; without those columns, unless there are no more."""
    own = [c for c in pairs.columns if c not in ("lo", "node")] or ["lo", "node"]
    both = pairs.join(sets.select(F.col("node").alias("lo"), F.col("n").alias("na"), F.col("held").alias("ha")), "lo").join(
        sets.select("node", F.col("n").alias("nb"), F.col("held").alias("hb")), "node")
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    return both.where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select(*own)


def _with_shared(sets: DataFrame, percent: int) -> DataFrame:
    """Sets with the number m of their shingles that some other node has, without the other shingles.

    A node whose own shingles are too many to be linked with anything is left out.
    """
    alone = sets.select("node", F.explode("held").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node"))
    alone = alone.where("k = 1").groupBy("node").agg(F.collect_list("s").alias("own"))
    rows = sets.join(alone, "node", "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
    rows = rows.withColumn("m", F.col("n") - F.size("own")).where(F.col("m") * 100 >= F.col("n") * percent)
    return rows.select("node", "n", "u", "m", "bits", F.array_except("held", "own").alias("held"))


def _crossed(a: DataFrame, b: DataFrame, sets: DataFrame, percent: int, once: Column) -> DataFrame:
    """Pairs of rows (key, tab, node, root, most) of ``a`` and ``b`` with one key, in two components, that may be linked, each in its first table only.

    ``once``: the order in which a pair is looked at, where ``a`` and ``b`` may hold it in both.
    """
    tasks = 4 * sets.sparkSession.sparkContext.defaultParallelism       # of few rows each: a large bucket is split by them
    left = a.select("key", "tab", "node", F.col("root").alias("root_a")).join(
        _profile(sets, "_a"), F.col("node") == F.col("node_a")).drop("node").coalesce(tasks)
    right = b.select("key", "node", F.col("root").alias("root_b"), F.col("most").alias("most_b")).join(
        _profile(sets, "_b"), F.col("node") == F.col("node_b")).drop("node").coalesce(tasks)
    met = left.join(right, (left["key"] == right["key"]) & (F.col("root_a") != F.col("root_b")) & once
                    & _can_link("_a", "_b", percent) & (_first_table(F.col("u_a"), F.col("u_b")) == F.col("tab")))
    return met.select(F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("node"),
                      F.least("root_a", "root_b").alias("r"), F.greatest("root_a", "root_b").alias("s"))


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose bucket holds more than one component; ``most`` is the one with most nodes there, ``at`` the place among ``many`` nodes."""
    bucket = Window.partitionBy("key")
    rows = rows.withColumns({"at": F.row_number().over(bucket.orderBy("node")), "a": F.min("root").over(bucket), "b": F.max("root").over(bucket),
                             "many": F.count(F.lit(1)).over(bucket)}).where("a != b").drop("a", "b")
    rows = rows.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("key", "root")))
    return rows.withColumn("most", F.max_by("root", F.struct("alike", -F.col("root"))).over(bucket)).drop("alike")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component that ``root`` now belongs to."""
    to = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return rows.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def _roots(nodes: DataFrame, sets_of, percent: int) -> list[DataFrame]:
    """Exact components of the nodes that share a key, as maps (node, root) to be followed one after the other.

    In each bucket all nodes meet its least one, and components are formed. In buckets of several components and more than PIVOTS nodes all
    then meet the least PIVOTS. Last, nodes outside the component that has most of a bucket meet all nodes of other components: nothing is
    left after that, so the number of rounds is fixed. Pairs inside a component need no look; a pair meets in the first table that it
    shares; only pairs that exact bounds don't rule out fetch their sets. So no link between components is lost, and a group of
    copies costs one row for each copy. Later rounds link the components of the rounds before.
    """
    keys = _keyed(nodes).repartition("key")     # one shuffle for the buckets and for their members
    rows = stored(keys.join(_spread(keys).select("key", "lo"), "key"), "members", few=True)
    sets = stored(_with_shared(sets_of(rows.select("node").distinct()), percent), "shared", few=True)
    edges = rows.where("node != lo").select("lo", "node").distinct()
    edges = edges.join(_profile(sets, "_a"), F.col("lo") == F.col("node_a")).join(_profile(sets, "_b"), F.col("node") == F.col("node_b"))
    maps = [components(stored(_confirmed(edges.where(_can_link("_a", "_b", percent)).select("lo", "node"), sets, percent), "links", few=True))]
    held = rows.join(sets.select("node"), "node", "left_semi").select("key", "tab", "node", F.col("node").alias("root"))
    rest = stored(_several(_rooted(held, maps[-1])), "rest", few=True)
    discard(rows)
    large = rest.where(F.col("many") > PIVOTS)
    if not large.isEmpty():
        pivots = large.where(F.col("at") <= PIVOTS)
        pairs = _crossed(pivots, large, sets, percent, F.col("node_a") < F.col("node_b"))       # pivots are the least: each pair once
        maps.append(components(stored(_confirmed(pairs, sets, percent).distinct(), "links", few=True), "r", "s"))
        before = rest
        rest = stored(_several(_rooted(rest.select("key", "tab", "node", "root"), maps[-1])), "rest", few=True)
        discard(before)
    outside = rest.where("root != most")
    once = (F.col("root_b") == F.col("most_b")) | (F.col("node_a") < F.col("node_b"))
    maps.append(components(stored(_confirmed(_crossed(outside, rest, sets, percent, once), sets, percent).distinct(), "links", few=True), "r", "s"))
    return maps


def _is_forest(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not seen.agg(F.max((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first()[0]


def components(links: DataFrame, a: str = "lo", b: str = "node") -> DataFrame:
    """(node, root) of every node in a link; the root is the least node that it reaches.

    Large-star and small-star steps on written edge tables, until the edges are stars.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    stars = None
    while not _is_forest(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars", few=True)
        if stars is not None:
            discard(stars)
        stars = edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common shingles >= percent * shingles of either; links are confirmed on full sets.
    Documents with equal sets are one node, so copies cost one row each. component_id is the smallest id that can be
    reached, the document's own included; ``kept`` says that it is its own. A text without words (or null) is linked
    with nothing. Repeated rows come out as often as they came in; rows without an id belong to the component of
    their text (null if no row of it has an id, and never kept unless it is null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    marks = stored(docs.select("id", _signature(words)("t").alias("s")).select("id", "s.*"), "signatures")
    nodes = stored(marks.where("n > 0").groupBy("mark").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("u").alias("u"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes", few=True)

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = stored(nodes.join(wanted, "node", "left_semi").select("mark", "id", "node", "n", "u"), "wanted", few=True)
        listed = ids.select(F.col("id").alias("wanted")).distinct().hint("merge")      # the list grows with the documents
        texts = docs.join(listed, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        held = texts.select(_shingles(words)("t").alias("s")).select("s.*")
        return stored(held.join(ids, "mark").dropDuplicates(["node"]).select("node", "n", "u", "bits", "held"), "sets", few=True)

    rooted = nodes.select("mark", "id", F.col("node").alias("root"))
    for roots in _roots(nodes, sets_of, percent):
        rooted = _rooted(rooted, roots)
    named = rooted.groupBy("root").agg(F.min("id").alias("component"))
    by_mark = rooted.join(named, "root").select("mark", "component")
    out = marks.select("id", "n", "mark").join(by_mark, "mark", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all columns.

    Rows are told apart by their id; rows without one always stay, since nothing names them.
    """
    groups = near_groups(docs, doc_id, text, words, percent)
    judged = groups.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("judged id")).agg(F.max("kept").alias("stays"))
    return docs.join(judged.where("not stays"), docs[doc_id] == F.col("judged id"), "left_anti")
