"""What the text operators leave on disk and in their workers."""

import os

import numpy as np

from pyspark.sql import functions as F

from factorspark.llm import common, decontamination, exact, neardup, packing, toxicity
from tests.llm.helpers import documents, prose


def shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, files in os.walk(str(d)) for f in files if f.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    table = common.stored(spark.range(5000).repartition(4, F.col("id") % 7), "test")
    assert not shuffled(spark) - before
    assert table.count() == 5000
    common.discard(table)
    assert not os.path.exists(table.stored_in.removeprefix("file:"))


def test_training_keeps_the_counts_alone(spark):
    rows = [(k, prose(k) + (" vile scum" if k % 2 else " kind words")) for k in range(40)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    folder = common.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    model = toxicity.train(docs, labels)
    assert {f.split("-")[0] for f in set(os.listdir(folder)) - before if not f.startswith("known")} == {"counts"}
    scored = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert min(scored[k] for k in range(1, 40, 2)) > max(scored[k] for k in range(0, 40, 2))


def test_counts_of_rare_words_hold_no_second_hash():
    """A key that is a hash isn't sent beside the word it was made of; what is read back is what was written."""
    r = np.random.default_rng(1)
    rare = np.unique(r.integers(1, 1 << 61, 3000) | toxicity.OTHER)
    words = np.concatenate([rare, -rare, r.integers(1, 200_000, 500)])
    before = np.concatenate([r.integers(1, 200_000, len(rare)), np.zeros_like(rare), r.integers(1, 200_000, 500)])
    keys = toxicity._keys(before, np.abs(words))
    columns = toxicity._summed(keys, words, before, np.ones_like(words), np.zeros_like(words))
    row = toxicity._write_counts(3, *columns)
    assert len(row["near"]) + len(row["far"]) < 11 * len(words)
    for got, want in zip(toxicity._read_counts([row["near"]], [row["far"]]), columns):
        assert (got == want).all()


def test_a_worker_holds_the_memo_of_one_operator():
    toxicity._words("one two three")
    assert len(toxicity._CODES) == 3
    neardup.shingle_set("four five", 2)
    assert not toxicity._CODES and len(neardup._CODES) == 2
    decontamination.views("six seven.")
    assert not neardup._CODES and decontamination._TOKENS
    packing.token_ids(["eight nine"])
    assert not decontamination._TOKENS and len(packing._TOKENS[None].place) == 2


def test_exact_dedup_moves_the_texts_once(spark):
    docs = documents(spark, [(k, prose(k % 30) if k % 5 else "same text") for k in range(200)] + [(None, None), (500, "")])
    plan = exact.exact_dedup(docs)._jdf.queryExecution().toString()
    assert plan.count("RangePartitioning") == 0 and plan.count("Window") == 0      # the stored runs are read, not made again
    want = {}
    for r in docs.collect():
        t = r["text"] or ""
        want[t] = max(want.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
    got = exact.exact_dedup(docs).collect()
    assert sorted((r["text"] or "", r["doc_id"]) for r in got) == sorted((t, k) for t, k in want.items())


def test_a_full_token_memo_keeps_what_is_met_again():
    tokens = packing.ChunkTokens(most=40)
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) + " the same words\n end  here" for k in range(6)]
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.encode(texts[:1])
    tokens.encode(texts[1:2])
    assert len(tokens.place) > 40
    assert [list(ids) for ids in tokens.encode(texts[2:3])] == want[2:3]
    assert "same" in tokens.place and "w0x1" not in tokens.place and "w1x1" not in tokens.place
    assert [list(ids) for t in texts for ids in tokens.encode([t])] == want


def test_plain_words_need_no_pattern_for_their_edges(monkeypatch):
    """Letters and digits alone have no edge and end no sentence; what is known of them is what the patterns say."""
    words = ["Word", "word", "42", "four", "km", "x2", "Éte", "٣", "²"]
    marked = decontamination._Tokens()
    want = [(int(marked.code[k]), marked.facts[k].tolist()) for k in (marked[f"({w}"] for w in words)]

    class Never:
        def sub(self, *_):
            raise AssertionError("a plain word was searched for edges")
    monkeypatch.setattr(decontamination, "EDGE", Never())
    plain = decontamination._Tokens()
    assert [(int(plain.code[k]), plain.facts[k].tolist()) for k in (plain[w] for w in words)] == want
