"""Text operators against brute force, and on odd rows: nulls, empty and long texts, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seaglint.llm import (
    chunk_bpe,
    license_scan,
    line_crf,
    links,
    log_bilinear,
    mixing,
    oracles,
    order_minhash,
    phrase_dedup,
    quality_qda,
    simhash,
    token_counts,
)

SMALL = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    extra = "row struct<a:int>, bytes int, words string, key int, digest int, shard int, n_words int, kept string, score int, signature int, ids int, label int, x int, token int, _slice int"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(None).cast(part.rsplit(" ", 1)[1] if "struct" not in part else "struct<a:int>").alias(part.split()[0]) for part in extra.split(", ")])


def texts_of():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "eps", "zeta,", "ETA", "theta.", "naïve", "日本", "x1", "#"] + [f"w{i}" for i in range(80)]
    body = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 160))) for _ in range(24)]
    passage = " ".join(f"p{i}" for i in range(40))
    body[3] += "\n" + passage
    body[7] = passage + " " + body[7]
    body[9] = "\n".join([passage, "Released under the MIT License.", passage])
    body[10] = "So so so " * 30
    body[11] = body[12]
    body[13] = "Licensed under CC BY-NC 4.0. cc by nc\n" + body[13]
    return body


@pytest.fixture(scope="module")
def docs(spark):
    body = texts_of()
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t)) for i, t in enumerate(body)]
    rows += [(100, None, None, "s1", None), (101, "", "en", "s1", 0), (102, " \t\n\x0b\r ", None, None, 6), (None, body[1], None, "s0", None), (None, None, None, None, None)]
    rows += [(103, body[4], "en", "s0", 1), (103, body[4], "en", "s0", 1)]
    rows += [(104, " ".join(f"long{i % 977}" for i in range(60_000)), "en", "s2", 1), (105, "a" * 300_000, "en", "s2", 1), (106, "<|endoftext|> x <|startoftext|>", None, "s2", 1)]
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def twin(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    return con.sql(sql)


def compare(df, rel):
    cols = rel.columns
    got, want = sortable(df.select(*cols).collect()), sortable(rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, nan_ok=True) if not any(isinstance(v, str) or v is None for v in a) else a == b


def test_license_scan(docs, empty):
    single = docs.where("doc_id is not null and doc_id <> 103")
    compare(license_scan.license_scan(single), twin(oracles.license_sql(), single))
    odd = {tuple(r) for r in license_scan.license_scan(docs).where("doc_id is null").select("n_words", "labels").collect()}
    assert (0, "") in odd and len(odd) == 2
    assert license_scan.license_scan(docs).where("doc_id = 103").count() == 2
    assert license_scan.license_scan(empty).count() == 0


def test_license_templates_out_of_order(spark):
    text = "version 3 of the gnu general public license " + "the " * 30 + "public license"
    found = license_scan.license_scan(spark.createDataFrame([(1, text), (2, "gnu general public license")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in found] == [("gpl-3", 1.0), ("", 0.0)]
    with pytest.raises(ValueError):
        license_scan.license_scan(spark.createDataFrame([(1, "")], "doc_id long, text string"), block_words=4)


def test_order_minhash(docs, plain, empty):
    got = order_minhash.edited_fingerprints(docs).collect()
    order = sorted(plain, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for i, (d, t) in enumerate(order):
        nxt, cut = order[(i + 1) % len(order)][1], len(t) // 4
        want.append((d, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sortable((r[0], r[1], r[2]) for r in got) == sortable(want)
    prints = {}
    for (_, t), r in zip(order, sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))):
        if r[0] is not None and r[0] < 100:
            assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 400 and r[0] is not None and r[0] < 24]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    assert order_minhash.edited_fingerprints(empty).count() == 0


def test_order_minhash_is_by_the_book(spark):
    """Signatures from the definition: occurrence numbers, smallest of each bin, text order."""
    h = lambda *parts: _spark_hash(spark, *parts)
    text = "a b a b a b c a b d"
    words = text.split()
    pairs = list(zip(words, words[1:]))
    seen, placed = Counter(), []
    for at, p in enumerate(pairs):
        seen[p] += 1
        placed.append((p, seen[p], at))
    kmer = {p: h(*p) for p in set(pairs)}
    mask = (1 << len(pairs).bit_length()) - 1
    values = sorted((h(kmer[p], np.int32(n)) & ~mask | at) for p, n, at in placed)
    bins = {}
    for v in values:
        bins.setdefault(v >> 58, []).append(v & mask)
    want = set()
    for b, ats in bins.items():
        ats = sorted(ats[:2])
        t = spark.sql(f"select xxhash64(array({', '.join(f'cast({kmer[pairs[a]]} as bigint)' for a in ats)}))").first()[0]
        want.add(np.int64((b << 26) | ((t & (2**64 - 1)) >> 38)).astype(np.int32).item())
    got = order_minhash.order_minhash(spark.createDataFrame([(text,)], "text string")).first()["signature"]
    assert set(got) == want and len(got) == len(bins)


def _spark_hash(spark, *parts):
    lit = [F.lit(int(p)).cast("int") if isinstance(p, np.int32) else F.lit(p).cast("long") if isinstance(p, int) else F.lit(p) for p in parts]
    return spark.range(1).select(F.xxhash64(*lit)).first()[0]


def test_fair_queue(docs, empty):
    single = docs.where("doc_id is not null and doc_id <> 103")
    queue = mixing.fair_queue(single).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    compare(queue, twin(oracles.mixing_sql(), single))
    whole = mixing.fair_queue(docs)
    assert whole.count() == docs.count() and whole.where("copies > 3").count() == 0
    copies = {(r["id"], r["size"]): r["copies"] for r in whole.where("id is not null and id <> 103").collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.where("doc_id is not null and doc_id <> 103").collect()) == Counter({d: c for (d, _), c in copies.items() if c})
    assert mixed.count() == whole.agg(F.sum("copies")).first()[0]
    assert mixing.fair_queue(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_stop_at_three_times(spark):
    sized = spark.createDataFrame([("a", 1), ("b", 100), ("c", 2), (None, 1000)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    # a and c stop at 3 and 6; b stops at 300; the rest is for the null source.
    assert got == pytest.approx({"a": 3.0, "b": 300.0, "c": 6.0, None: 794.0})


def test_language_scores(docs, plain, empty):
    got = log_bilinear.language_scores(docs, rounds=1).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    cut = lambda t: t.encode().lower().split() + [b""]
    count = Counter(w for d, t in plain if not held(d) for w in cut(t))
    n, v = sum(count.values()), len(count)
    want = [(d, held(d), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in cut(t)), 4)) for d, t in plain]
    assert sortable((*r[:5], round(r[5], 4)) for r in got) == sortable(want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert log_bilinear.language_scores(empty, rounds=1).count() == 0


@pytest.mark.parametrize("table", [log_bilinear.TABLE, 3])
def test_language_model_score_is_the_plain_softmax(docs, plain, monkeypatch, table):
    """Every score is the sum over its words of the product of three plain softmaxes; with a table of three, most words are rare."""
    monkeypatch.setattr(log_bilinear, "TABLE", table)
    made = {}
    train = log_bilinear.train
    monkeypatch.setattr(log_bilinear, "train", lambda texts, vocabulary, rounds: made.setdefault("all", (train(texts, vocabulary, rounds), vocabulary.value))[0])
    got = log_bilinear.language_scores(docs).collect()
    model, known = made["all"]
    cut = lambda t: t.encode().lower().split()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in plain if not held(d) for w in cut(t))
    own = {w: 1 + i for i, (w, c) in enumerate((w, c) for w, c in known.number.items() if count[w] >= log_bilinear.LEAST)}
    assert len(own) == known.n_own
    sign = lambda w: own.get(w, 1 + len(own) + zlib.crc32(w) % known.signs)
    together = Counter()
    for w, c in count.items():
        if w not in own:
            together[sign(w)] += c + 1

    def softmax(h, level, at):
        scores = model.output[level][at].astype(float) @ h + model.bias[level][at]
        return scores - np.log(np.exp(scores).sum())

    def log_share(a, b, w):
        h = model.context[b] * model.place[0] + model.context[a] * model.place[1]
        out, i, g = 0.0, w, model.group
        if w >= model.own:
            rest = w - model.own
            out += softmax(h, 1, np.arange(rest // g // g * g, min(rest // g // g * g + g, model.nodes[1])))[rest // g % g]
            out += softmax(h, 2, np.arange(rest // g * g, min(rest // g * g + g, model.nodes[2])))[rest % g]
            i = model.own + rest // g // g
        return (out + softmax(h, 0, np.arange(model.nodes[0]))[i]) / np.log(10)

    want = []
    for d, t in plain[:60]:
        signs = [0, 0, *map(sign, cut(t)), 0]
        score = sum(log_share(*signs[i : i + 3]) for i in range(len(signs) - 2))
        score += sum(np.log10((count[w] + 1) / (together[sign(w)] + 1)) for w in cut(t) if w not in own)
        want.append((d, score))
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], []).append(r["score"])
    for d, score in want:
        assert min(abs(s - score) / max(1, abs(score)) for s in scores[d]) < 1e-4, d


def language_vocabulary(made, more=()):
    """A vocabulary of these texts as the operator makes it; ``more`` are tokens left out of the table."""
    rows = Counter(w for t in made for w in t).most_common()
    every = [*rows, *more]
    shared = np.zeros((2, log_bilinear.shared_signs(len(every) + 1)), np.int64)
    for w, c in every:
        shared[:, zlib.crc32(w) % shared.shape[1]] += c, 1
    return log_bilinear.Vocabulary(rows, sum(c for _, c in every) + len(made), len(every) + 1, len(made), shared)


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    made = [[b"%c%d" % (b"ab"[k % 2], i) for i in rng.integers(0, 30, 60)] for k in range(200)]
    known = language_vocabulary(made)
    _, words, sizes = known.find(made)
    model = log_bilinear.Model(known.share)
    one, two = log_bilinear.contexts(words, sizes)
    before = model.log10(one, two, words).mean()
    state = np.full(len(model.values), 1e-4, np.float32)
    for k in range(12):
        model.learn(one, two, words, state, np.random.default_rng(k))
    assert model.log10(one, two, words).mean() > before + 0.1
    every = np.arange(model.n)
    assert (10 ** model.log10(np.full(model.n, 5), np.full(model.n, 9), every)).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_looks_a_token_up_once_for_a_run_of_texts():
    class Asked(dict):
        times = 0

        def get(self, key, default=None):
            self.times += 1
            return super().get(key, default)

    texts = [b"", b" \t", b"a B\x0b\x0cb  A\n", b"\x1cA\xc2\x85b rare", b"a\xff\xfeB \xc3\x80", b"a b " * 500, "\u3000 \u0130K".encode()]
    want = [t.lower().split() for t in texts]
    known = language_vocabulary([[b"a"] * 5, [b"b"] * 5])
    found, words, sizes = known.find(want)
    kinds, at, lengths = log_bilinear.cut(pa.array([b"x", *texts], pa.binary()).slice(1))
    assert [kinds[i].as_py() for i in at] == [w for t in want for w in t] and list(lengths) == list(sizes) == [len(t) for t in want]
    known.number = Asked(known.number)
    placed = known.place(log_bilinear.bytes_of(kinds), at, lengths)
    assert [list(p) for p in placed] == [list(found), list(words)]
    assert known.number.times == len(kinds) < len(at) / 50


def test_language_model_counts_runs_of_texts(spark, monkeypatch):
    texts = [b"", b"a B", b" b\tb ", b"A" * 90] * 30
    want = Counter(w for t in texts for w in t.lower().split()) + Counter({b"": len(texts)})
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "bytes binary")
    for size in (log_bilinear.COUNTED_BYTES, 100):
        monkeypatch.setattr(log_bilinear, "COUNTED_BYTES", size)
        assert {bytes(r["token"]): r["c"] for r in log_bilinear.token_counts(df.repartition(3)).collect()} == want
    # Without texts there is no end either, so that there are no distinct tokens.
    assert log_bilinear.token_counts(df.where("false")).count() == 0


def test_language_model_adds_up_repeated_rows_only():
    rows, grads = np.array([5, 2, 5, 9, 2, 5]), np.arange(18, dtype=np.float32).reshape(6, 3)
    own, sums = log_bilinear.moved(rows, grads)
    assert list(own) == [2, 5, 9] and sums.tolist() == [[15, 17, 19], [21, 24, 27], [9, 10, 11]]
    own, sums = log_bilinear.moved(rows[[3, 1]], grads[[3, 1]])
    assert list(own) == [2, 9] and sums.tolist() == [[3, 4, 5], [9, 10, 11]]


def test_language_model_tells_all_frequent_words_apart():
    rng = np.random.default_rng(0)
    made = [[b"%c%d" % (b"ab"[k % 2], i) for i in rng.integers(0, 1500, 400)] for k in range(600)]
    more = [(b"rare%d" % k, log_bilinear.LEAST - 1) for k in range(5000)]
    known = language_vocabulary(made, more)
    found, words, sizes = known.find(made)
    assert known.n_own == 3000 and len(set(known.word[found])) == 3000
    # Rare words are shared out: with their own signs there are more than a thousand signs of theirs.
    _, rare, _ = known.find([[w for w, _ in more]])
    assert len(set(rare[:-1])) > 900 and rare[:-1].min() > known.n_own
    assert round(sum(10**s for s in known.spread)) == sum(c + 1 for _, c in more) + known.signs
    model = log_bilinear.Model(known.share)
    one, two = log_bilinear.contexts(words, sizes)
    state = np.full(len(model.values), 1e-4, np.float32)
    before = model.log10(one, two, words).mean()
    for k in range(4):
        model.learn(one, two, words, state, np.random.default_rng(k))
    assert model.log10(one, two, words).mean() > before + 0.1
    every = np.arange(model.n)
    for a, b in ((5, 9), (2900, 9), (7, 1500), (2999, 2000)):
        assert (10 ** model.log10(np.full(model.n, a), np.full(model.n, b), every)).sum() == pytest.approx(1, abs=1e-4)


def test_least_frequent(spark):
    counts = spark.createDataFrame([(c,) for c in [1, 1, 2, 5, 5, 5000, 5001, 70_000]], "c long")
    assert log_bilinear.least_frequent(counts, 8) == 1
    assert log_bilinear.least_frequent(counts, 6) == 2
    assert log_bilinear.least_frequent(counts, 4) > 5
    assert log_bilinear.least_frequent(counts, 0) > 70_000


def brute_quality(t):
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n)


def test_quality_rules(docs, plain, empty):
    judged = line_crf.quality_rules(docs, line_crf.Field())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = judged.select("doc_id", *names, "kept").collect()
    assert sortable(r[:7] for r in got) == sortable((d, *brute_quality(t)) for d, t in plain)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert set(docs.columns) <= set(judged.columns)
    assert line_crf.quality_rules(empty, line_crf.Field()).count() == 0


def test_the_field_learns_from_the_end_of_long_documents():
    """Poor documents whose first 300 lines are as good as any; only the last ones differ."""
    rng = np.random.default_rng(8)
    plain = np.zeros(len(line_crf.FEATURES))
    plain[0] = 1.0

    def lines(n, digits):
        x = np.tile(plain, (n, 1))
        x[:, line_crf.FEATURES.index("digits")] = digits
        return x + rng.normal(0, 0.01, x.shape) * (plain == 0)

    good = [lines(int(n), 0.0) for n in rng.integers(1, 400, 40)]
    poor = [np.concatenate([lines(300, 0.0), lines(200, 0.3)]) for _ in range(10)]
    field = line_crf.fit(good + poor, [False] * 40 + [True] * 10)
    labels = field.viterbi(poor[0])
    assert labels[:300].mean() < 0.05 and labels[300:].mean() > 0.95
    runs = line_crf.Runs([x for x in good])
    assert sorted(np.concatenate(runs.places)) == list(range(len(runs.x))) and len(runs.x) == sum(map(len, good))


def test_viterbi_and_gradient_against_all_sequences():
    rng = np.random.default_rng(5)
    field = line_crf.Field(rng.normal(size=len(line_crf.FEATURES)), rng.normal(size=(2, 2)))
    x = rng.random((5, len(line_crf.FEATURES)))

    def score(f, y):
        s = x @ f.emit / 2
        return sum(s[i] if y[i] else -s[i] for i in range(5)) + sum(f.move[a, b] for a, b in zip(y, y[1:]))

    every = [[k >> i & 1 for i in range(5)] for k in range(32)]
    assert field.viterbi(x).tolist() == max(every, key=lambda y: score(field, y))
    y = [0, 1, 1, 0, 1]
    likelihood = lambda f: score(f, y) - np.logaddexp.reduce([score(f, z) for z in every])
    emit, move = field.gradient(line_crf.Runs([x]), np.array(y))
    for k in range(3):
        step = np.zeros_like(field.emit)
        step[k] = 1e-5
        slope = (likelihood(line_crf.Field(field.emit + step, field.move)) - likelihood(line_crf.Field(field.emit - step, field.move))) / 2e-5
        assert 5 * emit[k] == pytest.approx(slope, abs=1e-4)
    step = np.array([[0, 1e-5], [0, 0]])
    slope = (likelihood(line_crf.Field(field.emit, field.move + step)) - likelihood(line_crf.Field(field.emit, field.move - step))) / 2e-5
    assert 5 * move[0, 1] == pytest.approx(slope, abs=1e-4)


def test_quality_rules_on_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = line_crf.quality_rules(docs, line_crf.train(docs, labels)).join(labels, "doc_id").where("not base_failed")
    good, poor = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert poor.where("kept").count() <= 0.1 * poor.count()
    assert np.array_equal(line_crf.train(docs, labels.limit(0)).emit, line_crf.RULES)


def brute_print(t):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, plain, empty):
    got = simhash.fingerprints(docs).collect()
    prints = [brute_print(t) for _, t in plain]
    label = list(range(len(plain)))
    for i in range(len(plain)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
    first = lambda k: min((plain[i][0] for i in range(len(plain)) if label[i] == k and plain[i][0] is not None), default=None)
    assert sortable(got) == sortable((d, f"{p:016x}", first(k)) for (d, _), p, k in zip(plain, prints, label))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.fingerprints(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("shifts,large", [(32, 4096), (1, 4096), (1, 3)])
def test_cells_link_all_near_fingerprints(monkeypatch, shifts, large):
    monkeypatch.setattr(simhash, "SHIFTS", shifts)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    made = [base]
    for _ in range(20):
        y = base.copy()
        for _ in range(rng.integers(1, 4)):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        made.append(y)
    x = np.unique(np.concatenate(made))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    cell, own = simhash.cells(x).ravel(), np.repeat(x, 16)
    order = np.lexsort((own, cell))
    p, q = simhash.cell_links(cell[order], own[order])
    assert (np.bitwise_count(p ^ q) <= 64).all()
    assert np.array_equal(simhash.stars(np.searchsorted(x, p), np.searchsorted(x, q), len(x)), simhash.stars(a, b, len(x)))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (5, 4)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: r for n, r in label.items() if n != r}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(docs, plain, empty):
    size = phrase_dedup.WINDOW
    words = [t.encode().split() for _, t in plain]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    want = []
    for (d, _), w in zip(plain, words):
        gone = {k for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        want.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    for shard_bytes in (2_000_000, 3_000):
        found = phrase_dedup.remove_repeats(docs, shard_bytes=shard_bytes)
        assert sortable(found.select("doc_id", "n_words", "n_removed", "kept").collect()) == sortable(want)
    assert phrase_dedup.remove_repeats(empty).count() == 0


def test_automata_are_split(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "AUTOMATON", 3)
    rng = random.Random(4)
    passage = [f"q{i}".encode() for i in range(400)]
    texts = [passage] + [passage[rng.randrange(200) :][:90] + [b"end%d" % k] for k in range(12)]
    count = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    places = np.array([(t << 32) | i for t, w in enumerate(texts) for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1])
    _, gone, _ = phrase_dedup.removed([b" ".join(w) for w in texts], places)
    want = [len({k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}) for w in texts]
    assert gone == want


def test_token_counts(docs, plain, empty):
    library = token_counts.tokenizer(BYTE_BPE)
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in plain]
    for size in (50, 65_536):
        got = token_counts.token_counts(docs, BYTE_BPE, size=size).select("doc_id", "n_bytes", "n_tokens", "over_limit")
        assert sortable(got.collect()) == sortable(want)
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


def test_token_counts_of_odd_characters():
    odd = "İı ẞß Σς ﬁ １２ ½ ² Ⅷ 　    x ​ ﻿ \U0001f600 ͅ 'S 've 'lll  \n\n  a\r\n " + "".join(map(chr, range(0x20, 0x400)))
    lengths, library = token_counts.Lengths(BYTE_BPE, {}), token_counts.tokenizer(BYTE_BPE)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(40)))
        assert lengths.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_chunks_round_trip(docs, plain, empty):
    library = token_counts.tokenizer(WORD_BPE)
    want = []
    for d, t in plain:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = chunk_bpe.round_trip(docs, WORD_BPE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sortable(got.collect()) == sortable(want)
    coded = chunk_bpe.encode(docs, WORD_BPE).where("doc_id = 5").first()["ids"]
    assert chunk_bpe.decode(coded, WORD_BPE) == library.decode(coded, skip_special_tokens=False)
    assert chunk_bpe.round_trip(empty, WORD_BPE).count() == 0


def test_joins_are_repaired_wherever_the_text_is_cut():
    """Cuts inside words make joins that do not agree; repairing gives the library's ids all the same."""
    rng = random.Random(8)
    library = token_counts.tokenizer(WORD_BPE)
    text = " ".join(rng.choice(["running", "don't", "1234", "abc,def", "naive", "x", "\x01", "Überall"]) for _ in range(300)).encode()

    def anywhere(t):
        return sorted({k for k in range(1, len(t)) if t[k] < 0x80 and rng.random() < 0.05} | {len(t)})

    encoder = chunk_bpe.ChunkEncoder(WORD_BPE, cut=anywhere)
    assert encoder.encode([text])[0] == library.encode(text.decode(), add_special_tokens=False).ids
    assert encoder.widened > 0
    cut = chunk_bpe.cuts(text * 30)
    assert cut[-1] == len(text) * 30 and all((text * 30)[k] in chunk_bpe.SPACES for k in cut[:-1]) and len(cut) > 10


def test_quality_scores(spark, docs, plain, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_qda.quality_scores(docs, labels).collect()
    assert len(got) == len(plain) and all(0 <= r["score"] <= 1 for r in got)
    assert {(r["doc_id"], r["held_out"]) for r in got} == {(d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in plain}
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality_qda.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_qda.quality_scores(empty, labels).count() == 0


def test_quality_scores_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_qda.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    right = scored.where("predicted = quality").count()
    assert right >= 0.97 * scored.count()
