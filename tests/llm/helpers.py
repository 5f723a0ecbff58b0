"""Small tables and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import itertools
import random
import re

WORDS = "amber birch cedar delta ember flint grove heron inlet jetty knoll larch maple north olive pearl quartz raven slate thorn".split()


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows):
    """doc_id, text with a nullable id, and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, k, "x", True) for k, (i, t) in enumerate(rows)],
                                 "doc_id bigint, text string, b int, t string, kept boolean")


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows, k, percent):
    """Brute force: every pair of rows, links by exact sets, least reachable id."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    return [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))], [len(s) for s in sets]
