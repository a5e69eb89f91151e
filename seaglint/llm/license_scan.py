"""License scans: exact set-similarity join of licence templates with the blocks of all texts.

A block is ``block_words`` consecutive words, one starting every half block, so any run of half a block
lies whole in some block. A template is found in a block that holds at least ``containment`` of its
distinct words. Tokens are ordered by how many documents hold them, rarest first; in that order

* length filter: a block needs as many template-vocabulary tokens as the overlap asked for;
* prefix filter: with an overlap of ``a``, the first ``n - a + 1`` tokens of both sides share one;
* positional filter: at a shared token, what is left on both sides must still reach the overlap.

Words outside the templates' vocabulary can never match, so they count as rarest of all and are left out.
Pairs that pass are verified exactly. No text meets another: only the templates (a parameter of checked
size) are broadcast.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import UPPER

#: Phrases and the labels that they stand for.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Licence notices in general use, as lower-case words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
CONTAINMENT = 0.9
BLOCK_WORDS = 48
#: Most words that all templates may have together, as they are broadcast.
MAX_TEMPLATE_WORDS = 20_000

SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def license_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the words of the phrase stand one after another."""
    parts = phrase.split()
    rarest = max(parts, key=len)

    def at(word: Column, i: Column) -> Column:
        same = word == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(same, i)

    found = F.filter(F.transform(words, at), lambda i: i.isNotNull())
    return F.when(F.array_contains(words, rarest), found).otherwise(F.array().cast("array<int>"))


def token_order(docs: DataFrame, words: Column, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first; ties by the word."""
    held = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    seen = docs.select(F.explode(held).alias("t")).groupBy("t").count().collect()
    count = {r["t"]: r["count"] for r in seen}
    return sorted(vocabulary, key=lambda t: (count.get(t, 0), t))


def template_index(templates, ranked: list[str], containment: float) -> list[tuple]:
    """Prefix tokens of each template: token, place, tokens in all, overlap asked for, label, template."""
    rank = {t: i for i, t in enumerate(ranked)}
    index = []
    for text, label in templates:
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = max(1, ceil(round(containment * len(tokens), 9)))
        index += [(tokens[i], i, len(tokens), need, label, tokens) for i in range(len(tokens) - need + 1)]
    return index


def license_scan(
    docs: DataFrame,
    phrases=PHRASES,
    templates=TEMPLATES,
    containment: float = CONTAINMENT,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best containment of a template found, 1 where a phrase stands in the text, else 0. A
    null or empty text has no words, zero counts, null places and empty labels. Rows with the same id and
    text, null ids too, are each returned with the same result. Other columns do not matter.
    """
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    if sum(len(t.split()) for t, _ in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    if max((len(t.split()) for t, _ in templates), default=0) > block_words // 2:
        raise ValueError("a template is longer than half a block")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ranked = token_order(texts, license_words(F.col("text")), vocabulary)
    index = template_index(templates, ranked, containment)
    vocabulary_col = F.array(*map(F.lit, ranked)) if ranked else F.array().cast("array<string>")
    prefix_words = F.array(*map(F.lit, sorted({x[0] for x in index}))) if index else F.array().cast("array<string>")
    step = block_words // 2

    worded = texts.select("id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), license_words(F.col("text")).alias("words"))
    starts = [phrase_starts(F.col("words"), p) for p, _ in phrases]
    base = worded.select(
        "id",
        "digest",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.concat(*starts).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, phrases)])).alias("base"),
        F.when(F.arrays_overlap("words", prefix_words), F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1 - step), F.lit(step))).alias("blocks"),
    )
    blocks = base.select(
        "id",
        "digest",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        "base",
        # The first entry stands for the row itself, so that repeated rows are counted.
        F.posexplode(F.concat(F.array(F.array().cast("array<string>")), F.coalesce(F.transform("blocks", lambda s: F.array_intersect(vocabulary_col, F.slice("words", s + 1, block_words))), F.array().cast("array<array<string>>")))).alias("block", "tokens"),
    )
    indexed = docs.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(need).alias("need"), F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("template")) for t, i, n, need, label, tokens in index]))
    )
    placed = blocks.select("*", F.size("tokens").alias("n_tokens"), F.posexplode_outer("tokens").alias("j", "t"))
    b, t = placed.alias("b"), F.broadcast(indexed).alias("t")
    on = (
        (F.col("b.t") == F.col("t.token"))
        & (F.col("b.n_tokens") >= F.col("t.need"))
        & (F.col("b.j") <= F.col("b.n_tokens") - F.col("t.need"))
        & (1 + F.least(F.col("t.n") - 1 - F.col("t.i"), F.col("b.n_tokens") - 1 - F.col("b.j")) >= F.col("t.need"))
    )
    shared = F.size(F.array_intersect("tokens", "template"))
    found = b.join(t, on, "left").select(
        "id", "digest", "n_words", "n_base", "first_word", "last_word", "base", F.when(shared >= F.col("need"), shared / F.col("n")).alias("part"), "label",
        F.when(F.col("block") == 0, 1).alias("row"),
    )
    merged = found.groupBy("id", "digest", "n_words", "n_base", "first_word", "last_word", "base").agg(
        F.sum("row").cast("int").alias("rows"),
        F.max("part").alias("part"),
        F.collect_set(F.when(F.col("part").isNotNull(), F.col("label"))).alias("more"),
    )
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return merged.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )
