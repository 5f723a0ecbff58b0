import random

import numpy as np
from pyspark.sql import functions as F

from factorspark.llm import decontamination, html_text, language, queries, toxicity, warc
from tests.llm.helpers import WORDS, documents, prose

SF = "/root/testdata/sf0.01"


def brute_contains(text, item):
    """Whether an item's words stand in a text one after the other, whatever the case."""
    w = [x.strip(".,!?;:()\"'").lower() for x in (text or "").split()]
    v = [x.strip(".,!?;:()\"'").lower() for x in item.split()]
    w, v = [x for x in w if x], [x for x in v if x]
    return any(w[i:i + len(v)] == v for i in range(len(w) - len(v) + 1)) if v else False


def test_decontamination_finds_every_passage(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        held = {str(b["item_id"]) for b in items if brute_contains(t, b["text"])}
        assert held <= set(got[i]["items"].split(",")), i
    flagged = [i for i, r in got.items() if r["contaminated"]]
    assert flagged and all(any(b["text"][:30].lower() in texts[i].lower() or b["text"][-30:].lower() in texts[i].lower() for b in items) for i in flagged)


def test_decontamination_slots_and_edges(spark):
    item = "A train leaves the town with 40 people and Anna counts 15 km before Anna finds 40 coins"
    rows = [(1, "Well. " + item), (2, item.replace("40", "73").replace("Anna", "Bertha").replace("15 km", "21 miles")),
            (3, item.replace("with 40", "with 41")), (4, item.upper()), (5, None), (6, ""), (7, prose(3, 20_000)), (None, "Oh, " + item), (1, "Well. " + item),
            (8, item.replace("Anna finds", "Bertha finds")), (9, "A train leaves the town")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short words"), (4, "short words")], "item_id bigint, text string")
    docs = documents(spark, rows)
    out = decontamination.with_matches(docs, bench, "m")
    flags = [(r["doc_id"], bool(r["m"]), r["m"][0]["exact"] if r["m"] else None) for r in out.orderBy("b").collect()]
    assert flags == [(1, True, True), (2, True, False), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (7, False, None),
                     (None, True, True), (1, True, True), (8, False, None), (9, False, None)]
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 7
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")

    def found():
        return {(r["doc_id"], x) for r in decontamination.with_matches(docs, bench, "m").select("doc_id", "m.item").collect() for x in r["item"]}
    whole = found()
    blocks = decontamination.blocks
    monkeypatch.setattr(decontamination, "blocks", lambda *a: blocks(*a, most=500))
    assert whole and found() == whole


def test_toxicity_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in got if got[i]["held_out"] and i in labels]
    a = np.array([got[i]["score"] for i in held if labels[i]])
    b = np.array([got[i]["score"] for i in held if not labels[i]])
    assert len(a) and (a[:, None] > b[None, :]).mean() > 0.85
    assert np.mean([got[i]["predicted"] for i in held if not labels[i]]) < 0.02


def test_toxicity_edges(spark):
    r = random.Random(1)
    rows = [(k, prose(k, 30) + (" you vile rat" if k % 4 == 0 else "")) for k in range(200)]
    docs = documents(spark, rows + [(300, None), (301, ""), (302, "vile " * 100_000), (None, "vile rat"), (5, prose(5, 30))])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (7, None), (999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {x["doc_id"] for x in kept.collect()}
    assert ids == {k for k in range(200) if k % 4} | {300, 301}
    empty = toxicity.train(docs.limit(0), labels)
    assert toxicity.remove_toxic(docs, empty).count() == docs.count()
    assert toxicity.remove_toxic(docs.limit(0), model).count() == 0
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.remove_toxic(docs, one).count() == docs.count() and r


def test_language_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in got if got[i]["held_out"] and docs[i]["lang"]]
    assert got.keys() == docs.keys() and np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.97


def test_language_edges(spark):
    rows = [("der die das und ist nicht " * 9, "de"), ("the and of that with this " * 9, "en")] * 40
    docs = spark.createDataFrame([(a + str(k), b) for k, (a, b) in enumerate(rows)] + [(None, "en"), ("the", None)], "text string, lang string")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    asked = documents(spark, [(1, None), (2, ""), (3, "12 !? \n"), (4, "the and of that"), (5, "und nicht " * 100_000), (None, "das ist")])
    got = [r["p"] for r in asked.select("b", language.identifier(spark, model)(F.col("text")).alias("p")).orderBy("b").collect()]
    assert [p["lang"] for p in got] == ["und", "und", "und", "en", "de", "de"] and [p["score"] for p in got[:3]] == [0, 0, 0]
    none = language.train(docs.limit(0))
    assert {r["p"]["lang"] for r in asked.select(language.identifier(spark, none)(F.col("text")).alias("p")).collect()} == {"und"}


def test_html_on_labelled_layouts():
    model = html_text.train()
    wrong = total = 0
    for page in html_text.labelled_pages(80, seed=91):
        nodes, label = html_text._labelled(page)
        odds = model.marginals(nodes)
        marks = [(x > 0) != bool(y) for n, x, y in zip(nodes, odds, label) if n.tag == "#text"]
        wrong, total = wrong + sum(marks), total + len(marks)
    assert wrong / total < 0.06


def test_html_marginals_are_those_of_the_whole_tree():
    """Brute force: sum over all labellings of a small tree."""
    import itertools
    model = html_text.train()
    nodes = html_text.parse("<div class=menu><p>One two.</p></div><article><p>Three four five.</p></article>")
    odds = model.marginals(nodes)
    weight = np.zeros((len(nodes), 2))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        log = sum(model.potential(n) * s for n, s in zip(nodes, states))
        log += sum(model.edges[html_text.kind(n)][states[n.parent]][s] for n, s in zip(nodes[1:], states[1:]))
        for i, s in enumerate(states):
            weight[i, s] += np.exp(log)
    assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), odds)


def test_html_pages(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op8_html_extraction(spark, SF).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)[^>]*>|<br>", inside)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_html_edges(spark):
    model = html_text.train()
    pages = [None, "", "<", "<!-- open", "<script>var a = '<p>x</p>'", "<p>a &lt;b&gt;&nbsp; c<p>d", "<article>" + "<p>word word word word.</p>" * 20_000 + "</article>",
             "<article><p>" + "<b>" * 2000 + "deep text here." + "</article><footer>end</footer>", "</div></p>stray"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [r["t"] for r in df.select("i", html_text.extractor(spark, model)(F.col("html")).alias("t")).orderBy("i").collect()]
    assert got[0] == got[1] == got[3] == got[4] == "" and got[5] == "a <b> c\n\nd" and got[6].count("\n\n") == 19_999 and got[7] == "deep text here."


def capture(spark, rows):
    return spark.createDataFrame(rows, "url string, at timestamp, record_id string, kind string, status int, digest string, headers map<string,string>")


def test_warc_edges(spark):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("http://A.com/x/?utm_source=q", day(1), "r1", "response", 200, None, {"etag": '"1"', "content-type": "a", "date": "1"}),
            ("https://www.a.com:443/x#f", day(3), "r2", "response", 200, None, {"etag": '"2"'}),
            ("a.com/x", day(2), "v1", "revisit", 304, None, {"etag": 'W/"1"', "content-type": "no", "date": "2"}),
            ("a.com/x", day(4), "v2", "revisit", 304, None, {"etag": '"1"'}), ("a.com/x", day(4), "v3", "revisit", 304, None, None),
            ("b.com", day(4), "v4", "revisit", 304, None, {"etag": '"1"'}), (None, None, None, "revisit", None, None, None),
            ("a.com/x", day(0), "v5", "revisit", 304, None, {}), ("a.com/x", day(4), "v3", "revisit", 304, None, None),
            ("a.com/x", day(2), "e", "response", 500, None, {})]
    got = sorted([(r["record_id"], r["outcome"], r["target_id"], r["headers"]) for r in warc.resolve_revisits(capture(spark, rows)).collect()], key=str)
    assert got == sorted([("v1", "resolved", "r1", 'content-type: a\ndate: 2\netag: W/"1"'), ("v2", "mismatch", "r2", None),
                          ("v3", "unverified", "r2", 'etag: "2"'), ("v3", "unverified", "r2", 'etag: "2"'), ("v4", "no_target", None, None),
                          (None, "no_target", None, None), ("v5", "no_target", None, None)], key=str)
    assert warc.resolve_revisits(capture(spark, [])).count() == 0


def test_warc_hot_address_over_many_ranges(spark):
    import datetime as dt
    rows, want, last = [], {}, None
    for n in range(900):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
        if n % 50 == 0:
            last = f"r{n}"
            rows.append(("hot.com/", at, last, "response", 200, "d", {}))
        else:
            rows.append(("http://hot.com", at, f"v{n}", "revisit", 304, "d", {}))
            want[f"v{n}"] = last
    got = {r["record_id"]: r["target_id"] for r in warc.resolve_revisits(capture(spark, rows)).collect()}
    assert got == want


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, rid, at, http, uri="http://a.com/"):
        body = http.encode()
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {at}\r\nWARC-Target-URI: {uri}\r\n"
                f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    parts = [record("warcinfo", "w", "2024-01-01T00:00:00Z", "x"),
             record("response", "r", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "q"\r\nContent-Type: text/html\r\n\r\n<p>hello</p>'),
             record("revisit", "v", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "q"\r\nExpires: 9\r\n\r\n')]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    captures = warc.read_warc(spark, str(tmp_path))
    assert {r["record_id"]: bytes(r["payload"]) for r in captures.collect()} == {"r": b"<p>hello</p>", "v": b""}
    r = warc.resolve_revisits(captures).first()
    assert (r["outcome"], r["target_id"], r["headers"]) == ("resolved", "r", 'content-type: text/html\netag: "q"\nexpires: 9') and WORDS


def test_toxicity_keeps_rare_words_and_pairs(spark, monkeypatch):
    """Whatever fits the lists that go to the tasks: the scores are those of all words and pairs, counted by brute force."""
    rows = [(k, prose(k, 12) + (f" odd{k} vile rat{k % 3}" if k % 4 == 0 else f" odd{k} calm rat{k % 3}")) for k in range(60)]
    rows += [(100, "odd4 vile rat1 amber3 amber3"), (101, "rat0 unseen calm"), (102, ""), (103, None)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id bigint, toxic int")

    def scores():
        model = toxicity.train(docs, labels)
        asked = docs.select("doc_id", "text")
        return model, {r["doc_id"]: r["score"] for r in toxicity.scores(asked, model).collect()}
    model, whole = scores()
    count = {}
    for k, t in rows[:60]:
        w = t.split()
        for x in {*w, *zip(w, w[1:])}:
            count.setdefault(x, [0, 0])[k % 4 == 0] += 1
    pairs = [x for x in count if isinstance(x, tuple)]
    once, twice = (sum(sum(count[x]) == n for x in pairs) for n in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.5), 0.95)
    nt, no = 15, 45
    for k, t in rows:
        w, x = (t or "").split(), []
        ratios = [[], []]
        for h, v in zip([None, *w], w):
            if v not in count:
                continue
            shared = toxicity.BACKOFF * (1 + np.log1p(sum(p[1] == v for p in pairs))) / (nt + no)
            o, a = (max(c - d, 0) / n + shared for c, n in zip(count[v], (no, nt)))
            ratios[0].append(np.log(a / o))
            if (h, v) in count:
                back = toxicity.BACKOFF / (nt * a + no * o)
                o, a = (max(c - d, 0) / n + back * p for c, n, p in zip(count[h, v], (no, nt), (o, a)))
            ratios[1].append(np.log(a / o))
        for r in map(np.array, ratios):
            for tier in toxicity.TIERS:
                total = r[np.abs(r) >= tier].sum() if len(r) else 0.0
                x += [total / max(len(w), 1), total / max(len(w), 1) ** 0.5]
        assert abs(whole[k] - 1 / (1 + np.exp(-model.scale[0] - np.dot(model.scale[1:], x)))) < 1e-5, k
    for name in ("WORDS_MOST", "PAIRS_MOST"):
        monkeypatch.setattr(toxicity, name, 8, raising=False)
    few = scores()[1]
    assert few.keys() == whole.keys() and all(abs(few[k] - whole[k]) < 1e-5 for k in whole)


def test_decontamination_names_anywhere_and_plain_copies(spark):
    asked = "Anna has 5 apples in her bag. Anna gives 2 of them to a friend. Anna buys 3 more at the shop. Anna eats how many of them?"
    plain = "A train leaves the town with 40 people and Anna counts 15 km before Anna finds 40 coins"
    swapped = asked.replace("Anna", "Bertha").replace("5 ", "7 ")
    rows = [(1, asked), (2, swapped), (3, swapped.replace("Bertha", "Mary Jane")), (4, plain.upper()), (5, plain.lower()), (6, plain.title()),
            (7, "Well " + asked.replace(". ", ".\n")), (8, swapped.replace("Bertha gives", "Carla gives")), (9, prose(4, 300)), (10, prose(5, 300).title())]
    bench = spark.createDataFrame([(1, asked), (2, plain)], "item_id bigint, text string")
    found = decontamination.with_matches(documents(spark, rows), bench, "m", verbatim=True)
    got = {r["doc_id"]: [x["item"] for x in r["m"]] for r in found.collect()}
    assert got == {1: ["1"], 2: ["1"], 3: ["1"], 4: ["2"], 5: ["2"], 6: ["2"], 7: ["1"], 8: [], 9: [], 10: []}
    kept = decontamination.decontaminate(documents(spark, rows), bench, verbatim=True)
    assert {r["doc_id"] for r in kept.collect()} == {8, 9, 10}
