"""Token alignment, whitening and disclosure against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seaglint.llm import alignment, disclosure, whitening

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    extra = "row struct<a:int>, number int, pairs int, times int, base int, spans string, contexts int, entities int, bytes int, n int, id int"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(None).cast("struct<a:int>" if "struct" in part else part.rsplit(" ", 1)[1]).alias(part.split()[0]) for part in extra.split(", ")])


# ---- alignment -----------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(11)
    signs = ["a", "be", " ", "  ", "\n", "\t", " \n ", "é", "日本", "▁", " ", " ", "<s>", "<unk>", "<|endoftext|>", "'s", "12", "3", ".", "!?", "ß", "\x00", "\x1c", "\x85", "😀", "é"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return ["", " ", "  ", "\n", " lead", "trail ", "a  b", "a\n b", "a\n  b", "a   b", *made]


def align_by_hand(rows):
    """Rows of alignment, pair by pair, with whole-text encoding."""
    a, b = alignment.sides(BYTE_BPE, PIECES)
    found, counts = [], Counter()
    for i, text in rows:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = a.library.encode(want.decode(), add_special_tokens=False).ids, b.library.encode(text or "")
        if not text or a.joined(ids_a) != want or b.joined(ids_b) != want:
            found.append((i, None, [], 0))
            continue
        cover = []
        for side, ids in ((a, ids_a), (b, ids_b)):
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(side.entries[t]), t))
                at = own[-1][1]
            cover.append(own)
        ends = sorted({e for _, e, _ in cover[0]} & {e for _, e, _ in cover[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(t) for s, e, t in own if lo <= s and e <= hi) for own in cover))
            lo = hi
        links = [(x, y) for s, e, x in cover[0] for u, v, y in cover[1] if s < v and u < e]
        counts.update(set(links))
        found.append((i, (len(ids_a), len(ids_b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()), links, len(links)))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, own, links, n in found:
        own = own or (0, 0, 0, "")
        out.append((i, *own[:3], n, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), own[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 20, 0])
def test_alignment(spark, most):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "null id"), (501, "twice"), (501, "twice"), (502, " ".join(["so"] * 700)), (503, "x" * 2000)]
    got = alignment.alignment(frame(spark, rows).repartition(3), BYTE_BPE, PIECES, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == align_by_hand(rows)


def test_alignment_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 3000").collect()]
    got = alignment.alignment(docs.where("length(text) < 3000"), BYTE_BPE, PIECES).collect()
    assert sorted(map(tuple, got), key=repr) == align_by_hand(rows)


def test_alignment_long_and_empty(spark):
    long = " ".join(f"long{i % 977}" for i in range(60_000))
    got = alignment.alignment(frame(spark, [(1, long), (2, "a" * 200_000)]), BYTE_BPE, PIECES).orderBy("doc_id").collect()
    assert got[0]["n_a"] >= 60_000 and got[0]["n_links"] >= got[0]["n_groups"] >= 60_000 and got[1]["n_groups"] >= 1
    assert alignment.alignment(frame(spark, [(1, "x")]).limit(0), BYTE_BPE, PIECES).count() == 0
    assert [r["n_a"] for r in alignment.alignment(frame(spark, [(1, ""), (2, None)]), BYTE_BPE, PIECES).collect()] == [0, 0]


def test_pointers_reach_the_end_of_each_component():
    rng = np.random.default_rng(5)
    for _ in range(30):
        total = int(rng.integers(1, 400))
        ends = [np.append(np.flatnonzero(rng.random(total - 1) < p) + 1, total) for p in rng.random(2)]
        to_a, to_b = alignment.terminals(*ends)
        common = np.intersect1d(*ends)
        for own, to in zip(ends, (to_a, to_b)):
            assert (ends[0][to] == common[np.searchsorted(common, own)]).all()


# ---- whitening -----------------------------------------------------------------------------------


def whitened_by_hand(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    apart = n * x - total
    centred = apart / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:32], directions[:, ::-1][:, :32]
    trace = (centred**2).sum() / n
    return n, (apart**2).sum(axis=1), centred @ directions / np.sqrt(values.clip(1e-9)), values / trace


def test_whitening_of_the_table(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pandas()
    got = whitening.whiten(spark.read.parquet(f"{SMALL}/embeddings.parquet")).toPandas()
    n, deviation, want, explained = whitened_by_hand(np.stack(table["embedding"]))
    assert len(got) == n * 32 and set(got["n"]) == {n}
    for c in range(1, 33):
        own = got[got["component"] == c].set_index("vec_id").loc[table["vec_id"]]
        assert (own["deviation"].to_numpy() == deviation).all()
        sign = np.sign(own["whitened"].to_numpy() @ want[:, c - 1])
        assert np.allclose(sign * own["whitened"], want[:, c - 1], atol=1e-8)
        assert np.allclose(own["explained"], explained[c - 1], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=3)] + [7.0]) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 7.0]), (5, [0.0, -1.0, 0.5, 7.0]), (5, [0.0, -1.0, 0.5, 7.0])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [nan, 1.0, 1.0, 1.0]), (93, [1.0, -inf, 1.0, 1.0]), (94, []), (95, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("index", F.lit(1)).withColumn("row", F.lit("x")).withColumn("x", F.lit(2)).repartition(3)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * len(good) and not set(got["vec_id"].dropna()) & set(range(90, 96))
    assert (got["vec_id"].isna()).sum() == 4 and (got["vec_id"] == 5).sum() == 12
    flat = got[got["component"] == 4]
    assert (flat["whitened"] == 0).all() and (flat["explained"] == 0).all()
    assert got["identity_error"].max() < 1e-8
    _, deviation, _, _ = whitened_by_hand([v for _, v in good])
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 4 and all(r["whitened"] == r["explained"] == r["identity_error"] == r["deviation"] == 0 for r in got)
    assert whitening.whiten(same.limit(0)).count() == 0 and whitening.whiten(same.where("vec_id > 5")).columns == whitening.whiten(same).columns


# ---- disclosure ----------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, match):
    number = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [2 * d if i % 2 else d for i, d in enumerate(reversed(number))]
        return 12 <= len(number) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def spans_by_hand(text):
    found = [(m.start(), k, m.end(), kind, m[0]) for k, (kind, rx) in enumerate(PLAIN.items()) for m in rx.finditer(text) if passes(kind, m[0])]
    return sorted(found)


def test_base_spans_as_the_plain_patterns():
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "x.de", ".", "-", " ", "1", "22", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+1", "(509)", "555-0271", "\n", "é", "%", "_", "00012"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        assert [s[:3] for s in disclosure.base_spans(text)] == [s[:3] for s in spans_by_hand(text)], text
    for text in ("a" * 300_000, "@" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "+1" + "(" * 300_000, "a@" * 150_000, "1 " * 150_000):
        disclosure.base_spans(text)


def digest_by_hand(rows, window=10, threshold=0.75, least=2):
    """Every entity and term of the corpus, counted in full."""
    term = re.compile(r"[^\W_]+")
    kind_of = lambda t: "word" if t.isalpha() else "number" if t.isdigit() else "code"
    n, texts = len(rows), [t or "" for _, t in rows]
    has_term, has_class, has_entity = defaultdict(set), defaultdict(set), defaultdict(set)
    near_term, near_class, places = defaultdict(set), defaultdict(set), []
    for i, text in enumerate(texts):
        spans = spans_by_hand(text)
        for m in term.finditer(text):
            has_term[m[0].lower()].add(i)
            has_class[kind_of(m[0].lower())].add(i)
        free = [m for m in term.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e, _, _ in spans)]
        for s, _, e, kind, value in spans:
            plain = value.lower() if kind == "email" else ".".join(str(int(p)) for p in value.split(".")) if kind == "ip" else re.sub("[^0-9]", "", value)
            entity = (kind, plain)
            has_entity[entity].add(i)
            left, right = [m for m in free if m.start() < s], [m for m in free if m.start() >= e]
            inner = [m for m in free if s <= m.start() < e]
            for m in left[-window:] + inner + right[:window]:
                t = m[0].lower()
                near_term[entity, t].add(i)
                near_class[entity, kind_of(t)].add(i)
                places.append((i, entity, t, m.start(), m.end()))

    def share(near, part, entity):
        content = math.log2(n / len(has_entity[entity]))
        return math.log2(len(near) * n / (len(part) * len(has_entity[entity]))) / content if content > 0 else 0.0

    extra = defaultdict(dict)
    for i, entity, t, s, e in places:
        near = near_term[entity, t]
        if len(near) >= least and share(near, has_term[t], entity) >= threshold:
            gone = share(near_class[entity, kind_of(t)], has_class[kind_of(t)], entity) >= threshold
            extra[i][s, e] = max(extra[i].get((s, e), 4), 5 if gone else 4)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        base = [(s, k, e) for s, k, e, _, _ in spans_by_hand(texts[i])]
        names = [*PLAIN, "generalise", "remove"]
        text_of = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        counts = [sum(k == x for _, x, _ in base) for k in range(4)]
        out.append((doc_id, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(base + [(s, k, e) for (s, e), k in extra[i].items()])))
    return sorted(out, key=repr)


def private_rows():
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ünder", "42", "the", "the", "the"]
    said = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, said(rng.randrange(3, 60))) for i in range(120)]
    rows += [(200 + i, f"{said(15)} Agentone opens a7b9 mail John.Doe@Example.com {said(4)} harbour 4711 {said(12)}") for i in range(4)]
    rows += [(210 + i, f"ring Redboat at +1 (509) 555-0271, card 4111 1111 1111 1111 or 10.0.0.{i % 2} {said(9)}") for i in range(5)]
    return rows + [(300, None), (301, ""), (302, "a@b.cd"), (None, "the a@b.cd the"), (303, "same row me@x.org zebra"), (303, "same row me@x.org zebra"), (304, "4711 Redboat elsewhere"), (305, "İx alone")]


def test_disclosure_as_by_hand(spark):
    rows = private_rows()
    got = sorted(map(tuple, disclosure.private_digest(frame(spark, rows).repartition(3)).collect()), key=repr)
    want = digest_by_hand(rows)
    assert got == want
    assert any("generalise" in r[-1] for r in got) and any("remove" in r[-1] for r in got)
    assert next(r for r in got if r[0] == 304)[-1] == ""


def test_disclosure_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, disclosure.private_digest(docs).collect()), key=repr) == digest_by_hand(rows)


def test_sanitised_texts(spark):
    rows = private_rows()
    df = frame(spark, rows)
    got = disclosure.sanitise(df)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert "[EMAIL]" in texts[200] and "Agentone" not in texts[200] and "John" not in texts[200]
    assert "[PHONE]" in texts[210] and "[CARD]" in texts[210] and "[IP]" in texts[210]
    assert texts[300] == "" and texts[304] == "4711 Redboat elsewhere"
    assert disclosure.cleaned("abcdef", [{"start": 1, "kind": 0, "stop": 4}, {"start": 2, "kind": 2, "stop": 5}]) == "a[EMAIL]f"
    assert disclosure.private_digest(df.limit(0)).count() == 0 and disclosure.sanitise(df.limit(0)).count() == 0


def test_candidate_table_lets_all_candidates_through(spark):
    docs = spark.createDataFrame([(f"t{i} u{i} Öl{i}",) for i in range(300)], "text string")
    wanted = spark.createDataFrame([(f"öl{i}",) for i in range(0, 300, 3)], "term string")
    counts = {r["term"]: r["n"] for r in disclosure.document_counts(docs, wanted).where("term is not null").collect()}
    assert all(counts[f"öl{i}"] == 1 for i in range(0, 300, 3))
    assert len(counts) < 150
