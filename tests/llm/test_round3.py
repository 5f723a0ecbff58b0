import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.llm import filter_audit, language, quality, queries, ranked_search
from tests.llm.helpers import WORDS, prose

SF = "/root/testdata/sf0.001"


def equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- filter audit

def test_plain_changes_visit_every_order_once():
    for n in range(6):
        order = list(range(n))
        seen = [tuple(order)]
        for at in filter_audit.plain_changes(n):
            order[at:at + 2] = reversed(order[at:at + 2])
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def brute_steps(cells, names):
    out, shapley = [], Counter()
    for order in itertools.permutations(range(len(names))):
        earlier = 0
        for step, f in enumerate(order, 1):
            def total(test, k=0):
                return sum(w[k] for m, w in cells.items() if test(m))
            hit = [total(lambda m: m >> f & 1 and not m & earlier, k) for k in range(3)]
            out.append(["".join(names[g] for g in order), step, total(lambda m: not m & (earlier | 1 << f)), hit[0],
                        total(lambda m: m >> f & 1 and m & earlier), total(lambda m: m == 1 << f), hit[1], hit[2], f])
            shapley[f] += hit[0]
            earlier |= 1 << f
    return sorted((*r[:-1], shapley[r[-1]]) for r in out)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_diagrams_equal_brute_force(k):
    r = random.Random(k)
    for share in (0.0, 0.3, 1.0):
        cells = {m: (n := r.randrange(1, 9), r.randrange(n + 1), r.randrange(n + 1)) for m in range(1 << k) if r.random() < share}
        assert sorted(filter_audit.order_steps(cells, "ABCDE"[:k], 3)) == brute_steps(cells, "ABCDE"[:k])


def test_swapped_diagram_keeps_counts_and_shares_equal_parts():
    cells = {m: (1, 0, 0) for m in range(32)}
    d = filter_audit.Diagram(5, cells, 3)
    assert len(d.weight) == 6           # every level is one node
    for at in (0, 3, 1, 2, 0):
        d.swap(at)
        assert d.weight[d.root] == (32, 0, 0)
    assert sorted(d.order) == list(range(5))


def brute_masks(docs, labels):
    good = {i for i, q, t in labels if i is not None and q == 1}
    toxic = {i for i, q, t in labels if i is not None and t == 1}
    cells = {}
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        cell = cells.setdefault((lang or "", sum(1 << k for k, x in enumerate(fails) if x)), [0, 0, 0])
        for k, x in enumerate((True, i in good, i in toxic)):
            cell[k] += x
    return {k: tuple(v) for k, v in cells.items()}


def test_failure_cells_and_audit_on_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    some = prose(1, 120)
    docs = [(5, some, "en"), (3, some, "de"), (3, some, "de"), (9, some, None), (None, some, "en"), (7, "", "en"), (8, None, ""), (2, "A B\x0bC", "en"), (4, "a a a a|", "x"),
            (11, long, "en"), (12, long + " #", "en"), (13, "É" * 20 + "ABC", "fr"), (-1, "é 𝔘 ü", "fr")] + [(k, "hot text", "en") for k in range(20, 60)]
    labels = [(5, 1, 0), (5, 0, 1), (3, 1, None), (None, 1, 1), (20, 1, 1), (21, None, None), (99, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id bigint, text string, lang string, mask int, digest string")
    m = spark.createDataFrame([(*r, "en") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    cells = filter_audit.failure_cells(d, m)
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in cells.collect() if r["n"]}
    want = brute_masks(docs, labels)
    assert got == want
    rows = filter_audit.interaction_audit(cells, "ABCDE").toPandas()
    assert len(rows) == 600 * len({p for p, _ in want})
    for part, found in rows.groupby("part"):
        mine = {k: v for (p, k), v in want.items() if p == part}
        assert sorted(found.drop(columns="part").itertuples(index=False, name=None)) == brute_steps(mine, "ABCDE")
    assert filter_audit.interaction_audit(filter_audit.failure_cells(d.limit(0), m), "ABCDE").count() == 0
    assert filter_audit.failure_cells(d, m.limit(0)).agg(F.sum("n"), F.sum("good")).first()[:] == (len(docs), 0)
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(cells, "")


def test_filter_audit_equals_sql(spark):
    equals_sql(spark, "op12_filter_audit")


# ---- ranked search

def brute_ranked(docs, items, k=10):
    def terms(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, c.total()) for i, c in rows if c]
    big, length = len(rows), sum(n for _, _, n in rows)
    listed = {}
    for i, t in items:
        listed.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in listed.items():
        found = []
        for i, c, n in rows:
            m = 100 - 90 + (90 * n * big) // length
            score = 0
            for t in wanted & c.keys():
                df = sum(t in x for _, x, _ in rows)
                score += math.floor(1000 * math.log((2 * big + 2) / (2 * df + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_equals_brute_force_on_odd_rows(spark, monkeypatch):
    docs = [(k, prose(k, 5 + k % 50)) for k in range(150)] + [(k, "amber1 Birch2-cedar3") for k in range(200, 240)]
    docs += [(200, "amber1 Birch2-cedar3"), (None, "amber1 Birch2-cedar3"), (300, ""), (301, None), (302, "\x00 \x7f ..!"), (303, "ÀB çd 𝔘𝔘 Straße ÀB"), (-5, "amber1 " * 40_000),
             (304, "x" * 50_000)]
    items = [(1, "Amber1 birch2 CEDAR3"), (2, "àb ÀB straße"), (3, None), (4, ""), (None, "delta4"), (5, "delta4 ember5"), (5, "flint6"), (1, "Amber1 birch2 CEDAR3"), (6, "nowhere"), (7, prose(7, 40))]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, score int, item_id int").repartition(7)
    b = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id int, text string, doc_id int, rank int")
    want = brute_ranked(docs, items)

    def found(**k):
        return sorted(map(tuple, ranked_search.ranked(d, b, **k).collect()), key=repr)
    assert found() == want and len(want) > 30
    assert found(most=30) == want                       # blocks of items
    assert ranked_search.ranked(d.limit(0), b).count() == 0
    assert ranked_search.ranked(d, b.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.ranked(d.select("doc_id", F.lit(None).cast("string").alias("text")), b).count() == 0


def test_long_texts_are_split_between_terms(monkeypatch):
    text = " ".join(prose(k, 300) for k in range(4)).encode()
    whole = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "STEP", 7)
    assert ranked_search.term_counts(text) == whole
    assert ranked_search.term_counts(b"a" * 40 + b"-b") == {b"a" * 40: 1, b"b": 1}


def test_heaps_keep_the_best_with_ties():
    r = random.Random(4)
    offers = [(r.choice([None, *range(30)]), r.randrange(4)) for _ in range(200)]
    heaps = ranked_search.Heaps(1, 10)
    for doc, score in offers:
        heaps.offer(doc, np.array([score]))
    best = sorted(((-s, d is None, d or 0) for d, s in offers if s > 0))[:10]
    assert sorted((-s, d is None, d or 0) for _, s, d in heaps.rows()) == best


def test_ranked_search_equals_sql(spark):
    equals_sql(spark, "op13_ranked_search")


# ---- quality

def brute_vectors(texts):
    sums = np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
    for text in texts:
        b = [quality._BUCKETS[t] for t in quality.TOKEN.findall(text or "")]
        for i, x in enumerate(b):
            for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)):
                if j != i:
                    sums[x] += quality.INDEX[b[j]]
    length = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    return sums / np.where(length > 0, length, 1) + quality.INDEX[:-1] / np.sqrt(quality.NONZERO)


def brute_pooled(text, vectors):
    v = np.array([vectors[quality._BUCKETS[t]] for t in quality.TOKEN.findall(text or "")], float)
    if not len(v):
        return np.zeros(quality.VECTOR)
    step = np.sqrt(((v[1:] - v[:-1]) ** 2).mean(axis=0)) if len(v) > 1 else np.zeros(quality.WIDTH)
    return np.concatenate([v.mean(axis=0), v.std(axis=0), step])


def test_word_vectors_and_pooling_equal_brute_force(spark, monkeypatch):
    texts = [prose(k, 20 + k) + random.Random(k).choice(["", "!!", " | ## 17\nÉtude"]) for k in range(40)] + [None, "", "one", "% % %"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, bucket int").repartition(5)
    got = quality.word_vectors(docs)
    want = brute_vectors(texts)
    assert np.allclose(got[:-1], want, atol=1e-5) and not got[-1].any()
    assert np.allclose(quality.pooled(pd.Series(texts), got), [brute_pooled(t, want) for t in texts], atol=2e-3)
    monkeypatch.setattr(quality, "TOKENS", 50)          # the same in small steps
    assert np.allclose(quality.pooled(pd.Series(texts), got), [brute_pooled(t, want) for t in texts], atol=2e-3)


def test_pieces_of_a_long_text_hold_all_tokens(monkeypatch):
    text = prose(3, 500) + " " + "z" * 300
    whole = np.concatenate(list(quality.pieces(text)))
    monkeypatch.setattr(quality, "STEP", 200)
    cut = list(quality.pieces(text))
    assert len(cut) > 5 and (np.concatenate(cut)[:len(whole) - 1] == whole[:-1]).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 5)), rng.integers(0, 2, 9).astype(float)
    net = quality.Network(x.mean(axis=0), x.std(axis=0), rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), 0.2)
    g = quality.gradients(net, x, y)
    for name, got in zip(("w1", "b1", "w2"), g):
        p = getattr(net, name)
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-6
            up = quality.loss(net.logits(x), y)
            p[at] = old - 1e-6
            down = quality.loss(net.logits(x), y)
            p[at] = old
            assert abs((up - down) / 2e-6 - got[at]) < 1e-6


def test_fit_separates_and_calibrates():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 4000)
    x = rng.normal(size=(4000, 6)) + y[:, None] * 0.8
    net = quality.fit(x, y)
    held = rng.integers(0, 2, 4000)
    p = net.scores(rng.normal(size=(4000, 6)) + held[:, None] * 0.8)
    assert ((p > 0.5) == held).mean() > 0.8
    for low in np.arange(0, 1, 0.2):
        some = (p >= low) & (p < low + 0.2)
        assert abs(p[some].mean() - held[some].mean()) < 0.08
    assert (quality.fit(np.zeros((0, 6)), np.zeros(0)).scores(x[:3]) == 0.5).all()
    assert quality.fit(x[:60], np.ones(60)).scores(x[:60]).min() > 0.5


def test_quality_on_odd_rows(spark):
    good = [(k, prose(k, 30), 1) for k in range(80)]
    bad = [(100 + k, " ".join([WORDS[k % 20].upper() + "!!"] * 30), 0) for k in range(80)]
    rows = [(i, t) for i, t, _ in good + bad] + [(500, None), (501, ""), (501, ""), (None, good[0][1]), (3, good[3][1]), (502, "long " * 300_000), (503, bad[1][1]), (504, prose(999, 30))]
    labels = [(i, q) for i, _, q in good + bad] + [(500, 1), (0, 0), (504, None), (None, 1), (777, 0)]
    d = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id bigint, text string, score double, v string")
    m = spark.createDataFrame([(*r, "t") for r in labels], "doc_id bigint, quality int, text string")
    out = quality.quality_scores(d, m, F.col("doc_id") % 5 != 0).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    by = out.groupby("doc_id")["score"]
    assert (by.max() == by.min()).all()                 # repeated rows have one score
    s = by.first()
    assert s[504] > 0.5 > s[503] and abs(s[500] - s[501]) == 0
    assert quality.quality_scores(d.limit(0), m, F.lit(True)).count() == 0
    assert quality.quality_scores(d, m.limit(0), F.lit(True)).where("score = 0.5").count() == len(rows)


def test_training_sample_is_bounded_by_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS_EACH", 40)
    rng = np.random.default_rng(3)
    same = np.ones(quality.VECTOR, np.float32)
    rows = [(k, bytearray((same if k < 300 else rng.normal(size=quality.VECTOR).astype(np.float32)).tobytes())) for k in range(900)]
    vectors = spark.createDataFrame(rows, "doc_id bigint, v binary")
    labels = spark.createDataFrame([(k, int(k % 30 == 0)) for k in range(900)], "doc_id bigint, quality int")
    taken = {}

    def seen(x, y, seed=0):
        taken.update(x=x, y=y)
        return None
    monkeypatch.setattr(quality, "fit", seen)
    quality.train(vectors, labels, F.lit(True))
    assert (taken["y"] == 0).sum() == 40 and (taken["y"] == 1).sum() == 21       # 20 of their own, one of the shared text
    assert (taken["x"] == same).all(axis=1).sum() <= 2


def test_quality_held_out_accuracy_and_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_quality_classifier(spark, sf).toPandas()
    import zlib
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.3) == got["predicted"]).all() and got["score"].between(0, 1).all()
    both = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    ranks, pos = both["score"].rank(), both["quality"] == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.93 and (both[pos]["predicted"] == 1).mean() > 0.95


# ---- language identification

def test_texts_without_letters_are_undetermined_and_marks_stay():
    for text in (None, "", "½ ² ٣ 42 _ !", "\u0301\u0302"):
        assert language.letters(text) == ""
    assert language.letters("नमस्ते 5 दुनिया") == "नमस्ते दुनिया" and language.letters("Été½été") == "été été"
    model = language.fit(["abc def"] * 4 + ["xyz uvw"] * 4, ["a"] * 4 + ["b"] * 4)
    assert model.predict("½")[0] == "und" and model.predict("abc")[0] == "a"


def test_scores_equal_a_plain_softmax():
    rng = np.random.default_rng(4)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.5)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 ^ ord(c)) & 0xFFFFFFFF
        n = len(gram)
        return ((h * 0x9E3779B1 & 0xFFFFFFFF) ^ (n * 0x85EBCA6B & 0xFFFFFFFF)) >> 17
    for text in ("Ein kleines Haus!", "é", prose(5, 80)):
        clean = f" {language.letters(text)} "
        grams = [clean[i:i + n] for n in language.GRAMS for i in range(len(clean) - n + 1)]
        z = np.mean([model.logits[bucket(g)] for g in grams], axis=0) + model.bias
        p = np.exp(z / 0.7) / np.exp(z / 0.7).sum()
        lang, score, accepted = model.predict(text)
        assert lang == "abc"[p.argmax()] and abs(score - p.max()) < 1e-5 and accepted == (p.max() >= 0.5)


def test_language_sample_takes_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_EACH", 30)
    rows = [("the same text again", "en")] * 400 + [(prose(k, 6), "en") for k in range(200)] + [(f"rare {prose(k, 3)}", "xx") for k in range(3)] * 50
    rows += [(None, "en"), ("no language", None)]
    taken = {}
    monkeypatch.setattr(language, "fit", lambda texts, langs, seed=5: taken.update(t=texts, l=langs))
    language.train(spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, k int"))
    assert Counter(taken["l"]) == {"en": 30, "xx": 3} and len(set(taken["t"])) == 33


# ---- the capture log of the revisit query

def test_revisits_of_the_query_meet_every_case(spark):
    from factorspark.llm import warc
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = queries.op10_warc_revisits(spark, "/root/testdata/sf0.01").toPandas()
    assert set(out["outcome"]) == {"no_target", "mismatch", "unverified", "resolved"}
    assert len(out) == pages.count() and out["digest"].notna().sum() > len(out) / 2
    log = warc.captures_of_pages(pages).where("kind = 'response'").select(warc.canonical_url(F.col("url")).alias("u"), "record_id", "at").toPandas()
    newest = log.sort_values(["at", "record_id"]).groupby("u")["record_id"].last()
    met = out[out["target_id"].notna()]
    assert (met["target_id"].to_numpy() != newest[met["url_key"]].to_numpy()).mean() > 0.1      # the latest earlier one is often not the latest
    assert (met["target_at"] <= met["revisit_at"]).all()
