import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from factorspark.llm import neardup, packing
from tests.llm.helpers import components, documents, prose


def changed(text, at, n=1):
    w = text.split()
    for k in range(n):
        w[(at + 7 * k) % len(w)] = f"new{at}{k}"
    return " ".join(w)


def corpus():
    rows = [(k, prose(k, 40)) for k in range(20)]
    rows += [(100 + k, changed(prose(k % 4, 40), k, 1 + k % 3)) for k in range(60)]     # families at many distances
    rows += [(300 + k, rows[5][1]) for k in range(30)]                                   # copies
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "Été one"), (407, "été one")]
    return rows + [(500, prose(77, 20_000)), (501, changed(prose(77, 20_000), 5, 3)), (100, rows[20][1])]


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80)])
def test_near_groups_against_brute_force(spark, words, percent):
    rows = corpus()
    want, sizes = components(rows, words, percent)
    got = sorted(map(tuple, neardup.near_groups(documents(spark, rows), words=words, percent=percent).collect()))
    assert got == sorted((i, n, c, c == i) for (i, _), c, n in zip(rows, want, sizes))


def test_near_groups_in_many_rounds(spark, monkeypatch):
    """Few pivots: nodes of one bucket meet over several rounds, and no link is lost."""
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    rows = [(k, changed(prose(1, 60), 5 * k, 1 + k % 5)) for k in range(24)]
    want, _ = components(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(documents(spark, rows), words=2).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)}


def test_a_bucket_without_links_takes_few_rounds(spark, monkeypatch):
    """Texts that nearly link share buckets and stay apart: the rounds don't grow with the texts of a bucket."""
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rounds, formed = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda *a: rounds.append(1) or formed(*a))
    rows = [(k, prose(1, 90) + " " + prose(100 + k, 12)) for k in range(70)]
    want, _ = components(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(documents(spark, rows), words=2).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)} and len(set(want)) > 60
    assert len(rounds) <= 8


def test_near_groups_take_three_rounds_at_most(spark, monkeypatch):
    """The rounds don't depend on the size of a bucket: nodes that link with none, and a family that its least node has no part in."""
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rounds, formed = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda *a: rounds.append(1) or formed(*a))
    rows = [(k, prose(1, 90) + " " + prose(100 + k, 12)) for k in range(40)]
    rows += [(100 + k, changed(prose(1, 90) + " " + prose(100, 12), k, 1)) for k in range(12)]
    want, _ = components(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(documents(spark, rows), words=2).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)} and len(set(want)) > 30
    assert len(rounds) <= 3


def test_near_dedup_keeps_columns_and_null_ids(spark):
    docs = documents(spark, [(None, prose(1)), (4, prose(1)), (2, prose(1)), (None, None), (9, ""), (9, "")])
    out = neardup.near_dedup(docs)
    assert out.columns == docs.columns and sorted([r["doc_id"] for r in out.collect()], key=str) == [2, 9, 9, None, None]
    assert neardup.near_dedup(docs.limit(0)).count() == 0


def check_packing(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert sum(r["length"] for r in parts) <= packing.CAPACITY
    for i, text in texts.items():
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = np.append(packing.token_ids([text])[0], [])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert len(parts) == 1 or all(r["length"] == packing.CAPACITY for r in parts[1:])
        for r in parts:
            own = ids[r["start"]:r["start"] + r["length"]].astype("<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    return len(by_seq)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 60)
    rows = [(k, prose(k, 5 + (k * 37) % 300)) for k in range(400)] + [(900, None), (901, ""), (902, prose(1, 3000))]
    pieces = packing.tokenised(documents(spark, rows))
    out = packing.pack(pieces).collect()
    n = check_packing(out, dict(rows))
    assert n <= 1.01 * sum(r["length"] for r in out) / packing.CAPACITY + 1
    again = packing.pack(packing.tokenised(documents(spark, [(None, "a b"), (1, "c"), (1, "c")]))).collect()
    assert sorted([r["doc_id"] for r in again], key=str) == [1, 1, None] and len({(r["sequence_id"], r["offset"]) for r in again}) == 3
    assert packing.pack(pieces.limit(0)).count() == 0
    with_ids = packing.tokenised(documents(spark, rows[:50]), with_ids=True)
    made = packing.sequences(packing.pack(with_ids), with_ids).collect()
    assert sorted(x for r in made for x in r["ids"]) == sorted(int(x) for _, t in rows[:50] for x in packing.token_ids([t])[0])
    assert all(sum(r["lengths"]) == len(r["ids"]) for r in made)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(0, 5))
def test_evolve_is_a_packing(sizes, seed):
    groups = packing.evolve(sizes, 50, seed)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and all(sum(sizes[i] for i in g) <= 50 for g in groups)
    assert len(groups) <= 11 / 9 * -(-sum(sizes) // 50) + 6


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z1'.\n\t\r\x0b\x1c\x85  　é漢😀<|endoftext>")), max_size=40))
def test_chunks_have_the_ids_of_the_text(text):
    whole = packing.ChunkTokens().tokenizer if not packing._TOKENS else packing._TOKENS[None].tokenizer
    assert packing.token_ids([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage over a small corpus with one planted case each; toxic texts, copies, near copies and leaks go, the rest stays."""
    item = "Which of the seven rivers in the old northern province runs past the walls of the castle town"
    clean = [(k, prose(k, 80)) for k in range(120)]
    toxic = [(200 + k, prose(500 + k, 60) + " you vile filthy rat") for k in range(40)]
    copies = [(300, clean[3][1]), (301, clean[3][1])]
    near = [(302, clean[7][1] + " tail")]
    leaks = [(303, prose(900, 30) + ". " + item + ". " + prose(901, 30))]
    rows = clean + toxic + copies + near + leaks
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 240)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i for i, _ in clean} - {3} | {301}
    assert {r["doc_id"] for r in got} == kept
    check_packing(got, {i: t for i, t in rows if i in kept})
