"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import alone, small_batches, stored

CAPACITY, END_ID = 1024, 2
#: Pieces of an island on average, what an island may pass on, individuals and generations of an island's search.
ISLAND, PASSED_ON, POPULATION, GENERATIONS = 4096, 512, 6, 12
#: A space that a visible character follows starts a token of its own in a byte-level vocabulary.
CHUNK_EDGE = re.compile(r"(?= \S)")
ODD_SPACE = re.compile(r" (?!\S)")
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


class _Places(dict):
    """Chunk -> number, given out at the first question; ``new`` lists the chunks that still have no ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        self.new.append(chunk)
        return k


class ChunkTokens:
    """Token ids of whole texts by the given tokenizer file, with a memo of the ids of each chunk between spaces.

    A full memo forgets the chunks that no later batch held; most chunks are met once, and the others need not be encoded again.
    A text is cut before each space that a visible character follows. The pre-tokenizer of a byte-level vocabulary
    always cuts there and merges nothing across, so the ids of the chunks in order are those of the text.
    """

    def __init__(self, path: str | None = None, most: int = 1_000_000) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = True     # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a token of a byte-level vocabulary is spelled with one character for each byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.end = 0

    def _forget(self) -> None:
        """Keep the chunks that were met again, the newest half of the memo at most."""
        stays = self.again[:len(self.place)]
        if stays.sum() > self.most // 2:
            stays[np.flatnonzero(stays)[:-(self.most // 2) or None]] = False
        at, place = np.flatnonzero(stays), _Places()
        place.update(zip(compress(self.place, stays), range(len(at))))
        ids, n = self._gathered(at), self.count[at]
        self.clear()
        self.place = place
        if len(at):
            self._keep(np.arange(len(at)), ids, n)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks with these numbers, one after the other."""
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[at] - (ends - n), n) + np.arange(total)]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, as names: a chunk of a space and more goes without the space, any other has one more before it."""
        if ODD_SPACE.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and c[1] != " " else " " + c for c in CHUNK_EDGE.split(text) if c]
        names = text.split(" ")
        if names[0]:
            names[0] = " " + names[0]
            return names
        return names[1:]

    def _learn(self) -> None:
        """Ids of chunks that weren't met before: many are encoded as one text, and the bytes of the ids tell where each ends."""
        new, self.place.new = self.place.new, []
        first = len(self.place) - len(new)
        new = [name[1:] if name[0] == " " else " " + name for name in new]
        inner = [c[0] == " " and len(c) > 1 and not c[1].isspace() for c in new]
        at = np.flatnonzero(inner)
        for k in range(0, len(at), 4096):
            part = [new[i] for i in at[k:k + 4096]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            self._keep(first + at[k:k + 4096], ids, np.diff(stops, prepend=0))
        rest = np.flatnonzero(~np.array(inner, bool))
        if len(rest):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
            self._keep(first + rest, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got]))

    def _keep(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while at.max() >= len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        while self.end + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.end:self.end + len(ids)] = ids
        self.first[at], self.count[at] = self.end + np.cumsum(counts) - counts, counts
        self.end += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.most:
            self._forget()
        known = len(self.place)
        cut = [self.chunks(t) for t in texts]
        places = [np.fromiter(map(self.place.__getitem__, row), np.int64, len(row)) for row in cut]
        if self.place.new:
            self._learn()
        for at in places:
            self.again[at[at < known]] = True
        return [self._gathered(at) for at in places]


_TOKENS: dict[str | None, ChunkTokens] = {}


def token_ids(texts: list[str | None], path: str | None = None) -> list[np.ndarray]:
    """Ids of each text (null: empty) and the closing id."""
    if path not in _TOKENS:
        _TOKENS[path] = ChunkTokens(path)
    return [np.append(ids, np.uint32(END_ID)) for ids in alone(_TOKENS[path]).encode([t or "" for t in texts])]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first one may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _cutter(path: str | None, capacity: int, with_ids: bool):
    schema = PIECES + (", ids array<bigint>" if with_ids else "")

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for ids in token_ids(texts.to_list(), path):
                row = []
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[s:s + n]
                    got = {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(own.astype("<u4").tobytes())}
                    row.append(got | ({"ids": own.astype(np.int64)} if with_ids else {}))
                out.append(row)
            yield pd.Series(out)
    return cut


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None,
              capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 (and the ids themselves, if asked for)."""
    small_batches(docs.sparkSession)
    got = docs.select(F.col(doc_id).alias("doc_id"), F.explode(_cutter(tokenizer_path, capacity, with_ids)(F.col(text))).alias("p"))
    return got.select("doc_id", "p.*")


# ---- the search on one island ----

class _Open:
    """Bins of one individual by free room, for best fit in constant time: a bit for each room that some bin has."""

    def __init__(self, capacity: int) -> None:
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, b: int, room: int) -> None:
        self.room[room].append(b)
        self.mask |= 1 << room

    def best(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room that fits."""
        high = self.mask >> size
        if not high:
            return None
        room = size + (high & -high).bit_length() - 1
        b = self.room[room].pop()
        if not self.room[room]:
            self.mask &= ~(1 << room)
        return b, room


def _best_fit(groups: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Put items, in their order, into the fullest group that has room, or a new one."""
    opened = _Open(capacity)
    groups = [list(g) for g in groups]
    for b, g in enumerate(groups):
        opened.add(b, capacity - sum(size[i] for i in g))
    for i in items:
        got = opened.best(size[i])
        b, room = got if got else (len(groups), capacity)
        if not got:
            groups.append([])
        groups[b].append(i)
        opened.add(b, room - size[i])
    return groups


def _worth(groups: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer groups first; then the mean square of the fill, which favours full and empty over middling."""
    fill = np.array([sum(size[i] for i in g) for g in groups]) / capacity
    return -len(groups), float((fill ** 2).mean()) if len(groups) else 0.0


def _crossed(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject the best-filled third of b's groups into a; groups of a that share an item with them dissolve, and
    their other items are placed again, largest first, by best fit."""
    fill = np.array([sum(size[i] for i in g) for g in b])
    rank = np.argsort(-fill + rng.random(len(b)), kind="stable")
    injected = [b[k] for k in rank[: max(1, len(b) // 3)]]
    inside = {i for g in injected for i in g}
    whole = [g for g in a if not any(i in inside for i in g)]
    held = {i for g in whole for i in g}
    displaced = [i for g in a for i in g if i not in inside and i not in held]
    return _best_fit(injected + whole, sorted(displaced, key=lambda i: -size[i]), size, capacity)


def evolve(size: list[int], capacity: int, seed: int, migrants: list[list[int]] | None = None) -> list[list[int]]:
    """Groups of item numbers, as few as the search finds; it ends early at the lower bound of the volume.

    ``migrants``: groups that came from other islands. One individual keeps them and fits the rest around; the others
    start from orders of their own.
    """
    if not size:
        return []
    rng = np.random.default_rng(seed)
    bound = -(-sum(size) // capacity)
    order = sorted(range(len(size)), key=lambda i: -size[i])
    population = [_best_fit([], order, size, capacity)]
    if len(population[0]) <= bound:
        return population[0]
    if migrants:
        placed = {i for g in migrants for i in g}
        population.append(_best_fit(migrants, [i for i in order if i not in placed], size, capacity))
    while len(population) < POPULATION:
        noisy = sorted(range(len(size)), key=lambda i: -size[i] * rng.uniform(0.7, 1.0))
        population.append(_best_fit([], noisy, size, capacity))
    for _ in range(GENERATIONS):
        population.sort(key=lambda g: _worth(g, size, capacity), reverse=True)
        if len(population[0]) <= bound:
            break
        half = population[: max(2, POPULATION // 2)]
        children = [_crossed(half[k % len(half)], half[int(rng.integers(len(half)))], size, capacity, rng) for k in range(POPULATION - len(half))]
        # mutation: the worst-filled groups of the best dissolve
        worst = sorted(population[0], key=lambda g: sum(size[i] for i in g))
        loose = [i for g in worst[: max(2, len(worst) // 20)] for i in g]
        rng.shuffle(loose)
        children[-1] = _best_fit(worst[max(2, len(worst) // 20):], loose, size, capacity)
        population = half + children
    return max(population, key=lambda g: _worth(g, size, capacity))


OUT = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, sequence string, offset bigint, open boolean"


def _island(capacity: int, last: bool, turn: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        size = rows["length"].astype(int).to_list()
        came = {}
        for i, s in enumerate(rows["sequence"]):
            if s is not None and s == s:
                came.setdefault(s, []).append(i)
        groups = evolve(size, capacity, int(key[0]) * 31 + turn, list(came.values()))
        # what isn't full may travel on, the emptiest groups first, a bounded number of pieces
        fill = [sum(size[i] for i in g) for g in groups]
        passed = 0
        names, offsets, opened = np.empty(len(rows), object), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for b in sorted(range(len(groups)), key=lambda b: fill[b]):
            goes = not last and fill[b] < capacity and passed + len(groups[b]) <= PASSED_ON
            passed += len(groups[b]) if goes else 0
            at = 0
            for i in groups[b]:
                names[i], offsets[i], opened[i] = f"{turn}-{key[0]}-{b}", at, goes
                at += size[i]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence=names, offset=offsets, open=opened)
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Full pieces are sequences by themselves. The others are dealt at random to islands of a bounded number of pieces; each
    runs the genetic search on its own. Its well-filled groups are final; the others, whole groups of at most 512
    pieces in all, move to an island of the next turn, where eight islands' elites meet and take part in the
    search as they are. Turns go on until one island is left. Repeated rows are pieces of their own. Pieces
    of no tokens don't occur (each document ends in an id); longer ones than the capacity are refused.
    """
    spark = pieces.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = pieces.schema["doc_id"].dataType
    # ids as text inside: a null among numbers would turn them into floats in pandas
    pieces = stored(pieces.select(F.col("doc_id").cast("string").alias("doc_id"), *cols[1:]), "pieces")
    n, full, longest = pieces.agg(F.count(F.lit(1)), F.count_if(F.col("length") == capacity), F.max("length")).first()
    if n and longest > capacity:
        raise ValueError(f"a piece of {longest} tokens is longer than {capacity}")
    whole = pieces.where(F.col("length") == capacity).select(*cols, F.concat(
        F.lit("whole-"), F.monotonically_increasing_id().cast("string")).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    done = [whole]
    islands = max(1, -(-(n - full) // ISLAND))
    left = pieces.where(F.col("length") < capacity).select(*cols, F.lit(None).cast("string").alias("sequence"))
    deal = F.pmod(F.xxhash64(*cols, F.monotonically_increasing_id()), F.lit(islands))
    turn = 0
    while True:
        last = islands == 1
        packed = left.withColumn("island", deal).groupBy("island").applyInPandas(_island(capacity, last, turn), OUT)
        packed = stored(packed, "islands")
        done.append(packed.where("not open").drop("open"))
        if last:
            break
        left = packed.where("open").select(*cols, "sequence")
        islands, turn = -(-islands // 8), turn + 1
        deal = F.pmod(F.xxhash64("sequence"), F.lit(islands))   # a group travels whole
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select(F.col("doc_id").cast(kind).alias("doc_id"), *cols[1:], F.xxhash64("sequence").alias("sequence_id"), "offset")


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the length of each piece, in order of the offsets."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces_with_ids.dropDuplicates(key)
    joined = packed.join(ids, [packed[k].eqNullSafe(ids[k]) for k in key]).select(packed["sequence_id"], packed["offset"], packed["length"], "ids")
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                       F.transform("parts", lambda p: p["length"]).alias("lengths"))
