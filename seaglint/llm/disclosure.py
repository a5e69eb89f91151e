"""Personal data and the terms that give it away.

Emails, addresses, cards and phones are found by pattern; each value is a protected entity. How strongly a
term reveals an entity is estimated from the corpus: the pointwise mutual information of term and entity,
log2(n_te N / (n_t n_e)), as a share of the entity's information content, log2(N / n_e). N are all
documents, n_e those with the entity, n_t those with the term, n_te those in which the term stands within
``WINDOW`` terms of the entity. A term that discloses ``THRESHOLD`` of an entity or more, and stands near
it in ``LEAST`` documents or more, is generalised to its class (word, number, code) beside that entity, or
removed if the class itself discloses as much. Documents without entities stay as they are.

Document counts are needed for the candidate terms only. A bit table of fixed size tells the tasks which
terms may be candidates; it lets some others through, which a join drops again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seaglint.llm.common import ARROW, give_back, map_texts, materialise, prepare

KINDS = ("email", "ip", "card", "phone")
#: Terms on each side of an entity; share of its information; documents that a pair must have.
WINDOW, THRESHOLD, LEAST = 10, 0.75, 2
#: Bits of the candidate table: 2 MB.
BITS = 1 << 24
#: Terms that a task holds counts or answers for.
HELD = 400_000
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: All starts in one run of digits end alike, so only its first digit is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    last_first = [int(c) for c in reversed(number)]
    return (sum(last_first[::2]) + sum(sum(divmod(2 * d, 10)) for d in last_first[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the characters before it, back to the last match or @; so no run is read twice."""
    at, taken = text.find("@"), 0
    while at >= 0:
        head = text[taken:at]
        start = taken + len(head.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        taken = domain.end() if domain else at + 1
        at = text.find("@", taken)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind, end and value of all patterns, in code points; by start, then kind as listed."""
    found = [(s, 0, e, text[s:e].lower()) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end(), number))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(number := digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end(), number))
    return sorted(found)


def class_of(term: str) -> str:
    """What a term is generalised to."""
    return "word" if term.isalpha() else "number" if term.isdigit() else "code"


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> list[dict]:
    """The terms near each entity: entity, term, class, start and stop; ``first`` and ``first_class`` mark one for each pair."""
    if not spans:
        return []
    covered = [(s, e) for s, _, e, _ in spans]
    terms, at, reach = [], 0, 0
    for m in TERM.finditer(text):
        while at < len(covered) and covered[at][0] < m.end():
            reach, at = max(reach, covered[at][1]), at + 1
        if m.start() >= reach:
            terms.append((m.start(), m.end(), m[0].lower()))
    starts = [s for s, _, _ in terms]
    near: dict[str, set[int]] = {}
    for s, kind, e, value in spans:
        lo, hi = bisect_left(starts, s), bisect_left(starts, e)
        near.setdefault(f"{KINDS[kind]}:{value}", set()).update(range(max(0, lo - WINDOW), min(len(terms), hi + WINDOW)))
    out = []
    for entity, places in near.items():
        seen = set()
        for i in sorted(places):
            start, stop, term = terms[i]
            kind = class_of(term)
            out.append({"entity": entity, "term": term, "class": kind, "start": start, "stop": stop, "first": term not in seen, "first_class": (kind,) not in seen})
            seen |= {term, (kind,)}
    return out


SPAN = "struct<start:int,kind:int,stop:int>"
CONTEXT = "struct<entity:string,term:string,class:string,start:int,stop:int,first:boolean,first_class:boolean>"
ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
ARROW_CONTEXT = pa.struct([(n, pa.int32() if k == "int" else pa.bool_() if k == "boolean" else pa.string()) for n, k in (p.split(":") for p in CONTEXT[7:-1].split(","))])


def marked(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with their base spans, distinct entities and contexts."""

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        for found in runs:
            texts = [t.decode() for t in found]
            spans = [base_spans(t) for t in texts]
            yield {
                "base": [[{"start": s, "kind": k, "stop": e} for s, k, e, _ in own] for own in spans],
                "entities": [sorted({f"{KINDS[k]}:{v}" for _, k, _, v in own}) for own in spans],
                "contexts": [contexts(t, own) for t, own in zip(texts, spans)],
            }

    ARROW.setdefault(f"array<{SPAN}>", pa.list_(ARROW_SPAN))
    ARROW.setdefault(f"array<{CONTEXT}>", pa.list_(ARROW_CONTEXT))
    return map_texts(docs, run, f"base array<{SPAN}>, entities array<string>, contexts array<{CONTEXT}>", text_col)


def bit_table(terms: DataFrame) -> np.ndarray:
    """A bit for each hash of the column ``term``; at most BITS / 64 rows reach the driver."""
    h = terms.select(F.xxhash64("term").bitwiseAND(F.lit(BITS - 1).cast("long")).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))).alias("bits"))
    got = words.toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(table.astype("<u8").view(np.uint8), bitorder="little")


def document_counts(docs: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """term or class, and n: the documents that hold it, for candidate terms (some others too) and all classes."""
    prepare(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(candidates)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value)
        kinds: dict[str, tuple[str, bool]] = {}
        terms, classes = Counter(), Counter()

        def sent():
            names, kind = list(terms), list(classes)
            none = [None] * len(names), [None] * len(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(names + none[1], pa.string()), pa.array(none[0] + kind, pa.string()), pa.array([*terms.values(), *classes.values()], pa.int64())], names=["term", "class", "n"]
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                own, held = set(map(str.lower, set(TERM.findall(text)))), set()
                for term in own:
                    known = kinds.get(term)
                    if known is None:
                        if len(kinds) >= HELD:
                            kinds.clear()
                        known = kinds[term] = (class_of(term), bool(bits[xxh64_intdigest(term, 42) & (BITS - 1)]))
                    held.add(known[0])
                    if known[1]:
                        terms[term] += 1
                classes.update(held)
            if len(terms) > HELD:
                yield sent()
                terms, classes = Counter(), Counter()
        yield sent()
        give_back()

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term string, class string, n long")
    return partial.groupBy("term", "class").agg(F.sum("n").alias("n"))


def disclosure(near: Column, part: Column, entity: Column, rows: int) -> Column:
    """The share of an entity's information that a term, or a class, gives away."""
    content = F.log2(F.lit(rows) / entity)
    return F.when(content > 0, F.log2(near * F.lit(rows) / (part * entity)) / content).otherwise(0.0)


def revealing(docs: DataFrame, found: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """entity, term, share and action (generalise or remove) of the terms that give an entity away.

    ``found`` has the columns of ``marked`` for all rows of ``docs``.
    """
    near = found.select(F.explode("contexts").alias("c")).select("c.*")
    pairs = materialise(near.where("first").groupBy("entity", "term", "class").agg(F.count("*").alias("near")).where(F.col("near") >= least))
    rows = found.count()
    counts = materialise(document_counts(docs, pairs.select("term").distinct(), text_col))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    classes = near.where("first_class").groupBy("entity", "class").agg(F.count("*").alias("near_class"))
    of_term = counts.where("term is not null").select("term", F.col("n").alias("n_t"))
    of_class = counts.where("class is not null").select("class", F.col("n").alias("n_c"))
    known = pairs.join(of_term, "term").join(entities, "entity").join(classes, ["entity", "class"]).join(of_class, "class")
    own = disclosure(F.col("near"), F.col("n_t"), F.col("n_e"), rows)
    general = disclosure(F.col("near_class"), F.col("n_c"), F.col("n_e"), rows)
    shared = known.select("entity", "term", "class", own.alias("share"), general.alias("general"))
    action = F.when(F.col("general") >= threshold, F.lit("remove")).otherwise(F.lit("generalise"))
    return shared.where(F.col("share") >= threshold).select("entity", "term", "share", action.alias("action"))


def private_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, keep_row: bool = False) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, ``base`` and ``spans`` of each text; the input's columns in the struct ``row``.

    ``base`` is array<struct<start, kind, stop>>, kinds by number as in KINDS; ``spans`` has the spans of
    revealing terms too (kinds 4: generalise, 5: remove). Code points, end exclusive, by start and then
    kind. Null and empty texts have none. Repeated rows stay rows and count as documents of their own.
    Without ``keep_row``, ``row`` has all columns but the text.
    """
    kept = [c for c in docs.columns if keep_row or c != text_col]
    own = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("int")
    texts = docs.select(own.alias("row"), F.col(text_col).alias("text"))
    found = materialise(marked(texts, "text").drop("text").withColumn("number", F.monotonically_increasing_id()))
    flagged = materialise(revealing(docs, found, text_col, threshold, least))
    near = found.select("number", F.explode("contexts").alias("c")).select("number", "c.entity", "c.term", "c.start", "c.stop")
    hit = near.join(flagged, ["entity", "term"])
    kind = F.max(F.when(F.col("action") == "remove", 5).otherwise(4))
    terms = hit.groupBy("number", "start", "stop").agg(kind.alias("kind")).groupBy("number").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("terms"))
    joined = found.drop("contexts", "entities").join(terms, "number", "left")
    none = F.array().cast(f"array<{SPAN}>")
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select("row", *counts, "base", F.array_sort(F.concat("base", F.coalesce(F.col("terms").cast(f"array<{SPAN}>"), none))).alias("spans"))


def is_kind(number: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == number


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, [*KINDS, "generalise", "remove"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def cleaned(text: str, spans: list[dict]) -> str:
    """The text with a tag for each span; removed terms leave nothing; what overlaps an earlier span goes with it."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            own = text[s["start"] : s["stop"]]
            tag = "" if s["kind"] == 5 else f"[{class_of(own.lower()).upper()}]" if s["kind"] == 4 else f"[{KINDS[s['kind']].upper()}]"
            out += [text[at : s["start"]], tag]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``docs`` with the text sanitised: entities become tags, revealing terms their class or nothing.

    Null texts become empty; the columns are those of ``docs``.
    """
    found = private_spans(docs, text_col, threshold, least, keep_row=True)
    inner = found.select(F.col("row").alias("own"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"), "spans")
    out = pa.string()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array([cleaned(t, s) for t, s in texts], out)], names=["own", "clean"])
        give_back()

    made = inner.mapInArrow(rewrite, inner.select("own", F.lit("").alias("clean")).schema)
    return made.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def private_digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, counts of each kind, base_sha256 and spans as text, one row for each row of ``docs``."""
    found = private_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    counts = [f"n_{k}" for k in KINDS]
    return found.select(F.col("row.id").alias(id_col), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
