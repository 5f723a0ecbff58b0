"""Benchmark decontamination by templates: typed slots, hashed template windows, consistent slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.common import alone, small_batches, stored

#: Words of a template window (an item with fewer words is one window), and the share of an item's windows that a document
#: must hold, in a row of slots that is consistent, to count as holding the item.
WINDOW, COVERAGE = 8, 0.5
#: Words of benchmark items (each begins up to three windows) that go to the tasks at once; a larger benchmark is matched in as many passes as it needs.
BLOCK_WINDOWS = 1_000_000

# Number words and units that a template leaves open.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                         "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
                  "kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
                  "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars "
                  "euro euros % percent degree degrees mph kmh km/h w kw kwh v hz khz mhz ghz kb mb gb tb".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%]+$")
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3
SIEVE = np.uint64((1 << 22) - 1)
_MIX, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_SLOT = {k: _code(f"<{name}>") for k, name in ((NUM, "number"), (UNIT, "unit"), (NAME, "name"))}


LINE = "\x00"


class _Tokens(dict):
    """Raw token -> row of ``facts``: kind, whether it is a name inside a sentence, whether it ends one, whether it is a word.

    A memo that is emptied at 400,000 entries; what a token is depends on the token alone.
    """

    def __init__(self) -> None:
        super().__init__()
        self.code = np.zeros(1 << 16, np.uint64)
        self.facts = np.zeros((1 << 16, 4), np.int8)

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == len(self.code):
            self.code = np.concatenate([self.code, np.zeros_like(self.code)])
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        whole = token.isalnum()     # letters and digits alone: no edge to take off, no mark that ends a sentence
        word = token if whole else EDGE.sub("", token)
        low = word.lower()
        number = not word.isalpha() and NUMBER.fullmatch(word)
        kind = NUM if number or low in NUMBER_WORDS else UNIT if low in UNITS else PLAIN
        name = kind == PLAIN and len(word) > 1 and word[0].isupper() and word[1:].islower()
        ends = not whole and (token == LINE or token.rstrip("\"')]}»”").endswith((".", "!", "?", ":")))
        self.code[k], self.facts[k] = _code(low), (kind, name, ends, bool(word) and token != LINE)
        self[token] = k
        return k


_TOKENS = _Tokens()


#: The views of a text whose windows are compared: TYPED (template), FREE (a template in which a name's place and length
#: don't matter) and VERBATIM (the plain words in lower case).
TYPED, FREE, VERBATIM = 0, 1, 2
View = tuple[np.ndarray, np.ndarray, np.ndarray]


def views(text: str | None) -> list[View]:
    """Template codes, slot kinds (0: a plain word) and word codes of a text, in each view.

    TYPED: numbers, units, and capitalised words inside a sentence become typed slots; other words stand in lower case.
    A line break begins a sentence, like the end of one, so a name that begins it is a plain word.
    FREE: a capitalised word is a name wherever it stands, and a run of one kind inside a sentence is one slot.
    """
    tokens = (text or "").replace("\n", f" {LINE} ").split()
    if len(alone(_TOKENS)) > 400_000:
        _TOKENS.clear()
    at = np.fromiter(map(_TOKENS.__getitem__, tokens), np.int64, len(tokens))
    code, facts = _TOKENS.code[at], _TOKENS.facts[at]
    begins = np.ones(len(at), bool)
    begins[1:] = facts[:-1, 2]
    keep = facts[:, 3] == 1
    # a word after a line break or a bare mark begins too
    sentence = np.cumsum(begins)[keep]
    code, facts, begins = code[keep], facts[keep], begins[keep]
    typed = np.where((facts[:, 1] == 1) & ~begins, np.int8(NAME), facts[:, 0])
    free = np.where(facts[:, 1] == 1, np.int8(NAME), facts[:, 0])
    first = np.ones(len(free), bool)
    first[1:] = (free[1:] == PLAIN) | (free[1:] != free[:-1]) | (sentence[1:] != sentence[:-1])
    starts = np.flatnonzero(first)
    within = np.arange(len(free)) - starts[np.cumsum(first) - 1] if len(free) else starts
    joined = np.add.reduceat(code * (2 * within + 1).astype(np.uint64), starts) if len(starts) else code
    return [(_shape(typed, code), typed, code), (_shape(free[starts], joined), free[starts], joined), (code, np.zeros_like(typed), code)]


def _shape(kind: np.ndarray, code: np.ndarray) -> np.ndarray:
    shape = code.copy()
    for k, slot in _SLOT.items():
        shape[kind == k] = slot
    return shape


def windows(shape: np.ndarray, width: int, view: int) -> np.ndarray:
    """Hash of the window of a view that begins at each place."""
    rows = len(shape) - width + 1
    if rows <= 0:
        return np.empty(0, np.uint64)
    h = np.full(rows, width + (view << 32), np.uint64)
    for k in range(width):
        h ^= shape[k:k + rows]
        h *= _MIX
        h ^= h >> np.uint64(29)
        h *= _ROLL
    return h ^ (h >> np.uint64(32))


@dataclass
class Index:
    """A block of benchmark items: their views, and the windows of all views sorted by hash."""

    ids: list
    items: list[list[View]]
    widths: list[list[int]]     # of each view
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    sieve: np.ndarray           # whether some window has these low bits

    @staticmethod
    def of(ids: list, texts: list[str | None], window: int) -> Index:
        items = [views(t) for t in texts]
        hashes, owner, place = [], [], []
        for k, item in enumerate(items):
            for view, (shape, kind, _) in enumerate(item):
                width = min(window, len(shape))
                h = windows(shape, width, view) if len(shape) else np.empty(0, np.uint64)
                at = np.arange(len(h))
                if view == FREE:    # of a window with less than half plain words only slots would be left
                    plain = np.append(0, np.cumsum(kind == PLAIN))
                    at = at[2 * (plain[at + width] - plain[at]) >= width]
                hashes.append(h[at])
                owner.append(np.full(len(at), k))
                place.append(at)
        join = lambda x, t: np.concatenate([*x, np.empty(0)]).astype(t) if x else np.empty(0, t)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        sieve = np.zeros(int(SIEVE) + 1, bool)
        sieve[(every & SIEVE).astype(np.int64)] = True
        widths = [sorted({min(window, len(item[view][0])) for item in items if len(item[view][0])}) for view in (TYPED, FREE, VERBATIM)]
        return Index(ids, items, widths, every[order], join(owner, np.int64)[order], join(place, np.int64)[order], sieve)

    def _met(self, shape: np.ndarray, view: int, window: int) -> dict[tuple[int, int], list[int]]:
        """(item, where the item would begin in the text) -> item windows."""
        met: dict[tuple[int, int], list[int]] = {}
        for width in self.widths[view]:
            h = windows(shape, width, view)
            if not len(h):
                continue
            some = np.flatnonzero(self.sieve[(h & SIEVE).astype(np.int64)])
            lo = np.searchsorted(self.hashes, h[some])
            for i, k in zip(some.tolist(), lo.tolist()):
                while k < len(self.hashes) and self.hashes[k] == h[i]:
                    item, at = int(self.owner[k]), int(self.place[k])
                    if min(window, len(self.items[item][view][0])) == width:
                        met.setdefault((item, i - at), []).append(at)
                    k += 1
        return met

    def matches(self, text: str | None, window: int, coverage: float, verbatim: bool = False) -> list[tuple]:
        """(item id, share of its windows found, exact) of each item that the text holds."""
        if not len(self.hashes):
            return []
        own_views = views(text)
        out: dict[int, tuple[float, bool]] = {}
        # windows of plain words stand at the places of the typed ones, and are added to them
        for group in ((TYPED, VERBATIM) if verbatim else (TYPED,), (FREE,)):
            found: dict[int, tuple[set, bool]] = {}
            for view in group:
                shape, _, code = own_views[view]
                for (item, begin), places in sorted(self._met(shape, view, window).items()):
                    seen, exact = found.get(item, (set(), True))
                    own_shape, own_kind, own_code = self.items[item][view]
                    if view != VERBATIM:
                        width = min(window, len(own_shape))
                        covered = np.zeros(len(own_shape), bool)
                        for at in places:
                            covered[at:at + width] = True
                        inside = np.flatnonzero(covered)
                        if not _consistent(own_kind[inside], own_code[inside], code[inside + begin]):
                            continue
                        exact = exact and bool((own_code[inside] == code[inside + begin]).all())
                    found[item] = (seen | set(places), exact)
            for item, (places, exact) in found.items():
                size = len(self.items[item][group[0]][0])
                share = len(places) / max(1, size - min(window, size) + 1)
                if share >= coverage and (item not in out or share > out[item][0]):
                    out[item] = (float(share), exact)
        return [(self.ids[item], share, exact) for item, (share, exact) in sorted(out.items())]


def _consistent(kind: np.ndarray, own: np.ndarray, other: np.ndarray) -> bool:
    """Whether slots of a kind map one to one: equal values in the item are equal in the text, different ones differ."""
    for k in (NUM, UNIT, NAME):
        at = kind == k
        pairs = set(zip(own[at].tolist(), other[at].tolist()))
        if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
            return False
    return True


MATCHES = "array<struct<item:string,coverage:double,exact:boolean>>"


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, most: int = BLOCK_WINDOWS) -> Iterator[Index]:
    """The benchmark in blocks of a bounded number of windows, each read by itself."""
    rows = stored(benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "items")
    size = F.size(F.split("text", r"\s+"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // most)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).orderBy("id", "text").toPandas()
        yield Index.of(part["id"].to_list(), part["text"].to_list(), window)


def _matcher(spark: SparkSession, index: Index, window: int, coverage: float, verbatim: bool):
    sent = spark.sparkContext.broadcast(index)

    @F.pandas_udf(MATCHES)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"item": i, "coverage": c, "exact": e} for i, c, e in sent.value.matches(t, window, coverage, verbatim)] for t in texts])
    return match.asNondeterministic()


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, verbatim: bool = False) -> DataFrame:
    """``docs`` with a column of the benchmark items that each row holds (MATCHES, empty if none), by item id.

    A row is judged by its own whole text, so repeated rows, null ids and further columns do no harm; null and empty texts,
    and items without words, match nothing. ``verbatim``: windows of equal words count whatever their case and slots, so copies in
    capitals or lower case are found too; without it every window must be one of a consistent template. No text is shuffled. A benchmark of more than BLOCK_WINDOWS words
    takes several passes, with what earlier ones found written out between them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.columns
    out = docs.withColumn(column, F.array().cast(MATCHES))
    for k, index in enumerate(blocks(benchmark, item_id, item_text, window)):
        if k:
            out = stored(out, "matched")
        found = _matcher(spark, index, window, coverage, verbatim)(F.col(text))
        out = out.select(*[F.col(f"`{c}`") for c in own], F.concat(F.col(column), found).alias(column))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  verbatim: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, re-parameterised ones included, with all their columns."""
    column = "benchmark items held"
    while column in docs.columns:
        column += "'"
    return with_matches(docs, benchmark, column, text, item_id, item_text, verbatim=verbatim).where(F.size(F.col(f"`{column}`")) == 0).drop(column)
