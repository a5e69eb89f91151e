"""Every stage of the corpus pipeline by itself on odd rows, and the whole run against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import WORD_BPE, WORDS, brute_print, docs, table  # noqa: F401

import corpus_pipeline
from seaglint.llm import line_crf, mixing, phrase_dedup, token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_rows(spark, docs, number):  # noqa: F811
    _, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, FOLDER)
    rows = out.collect()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if number < 4:
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert all(r["kept"] is None and r["n_words"] is None for r in rows)
    else:
        assert len(rows) == docs.count()


def test_run_against_brute_force(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    field = line_crf.train(source, labels)
    kept = [r for r in source.collect() if line_crf.judge(r["text"].encode(), field)[-1]]
    prints = {r["doc_id"]: brute_print(r["text"]) for r in kept}
    label = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    kept = [r for r in kept if label[r["doc_id"]] == r["doc_id"]]
    size = phrase_dedup.WINDOW
    words = {r["doc_id"]: WORDS.findall(r["text"]) for r in kept}
    count = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    text = {}
    for r in kept:
        w = words[r["doc_id"]]
        gone = {k for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        text[r["doc_id"]] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
    left = spark.createDataFrame([(r["doc_id"], text[r["doc_id"]], r["source"]) for r in kept], "doc_id long, text string, source string")
    copies = {r["id"]: r["copies"] for r in mixing.fair_queue(left).collect()}
    library = token_counts.tokenizer(WORD_BPE)
    want = Counter((r["doc_id"], r["source"], tuple(library.encode(text[r["doc_id"]], add_special_tokens=False).ids)) for r in kept for _ in range(copies[r["doc_id"]]))
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in got.collect()) == want
    assert got.where(F.col("n_tokens") != F.size("ids")).count() == 0
