"""Substring dedup by repeated-phrase automata.

1. Every window of ``WINDOW`` words picks its smallest hashed phrase of ``ANCHOR`` words. Equal windows
   pick equal phrases, so only windows whose pick occurs twice anywhere can recur.
2. Those windows are confirmed by counting 96-bit hashes over all documents.
3. Documents are dealt to shards of bounded size. A shard gets the places of its confirmed windows, joins
   neighbouring ones to passages, and compiles an Aho-Corasick automaton of phrases that stand every
   ``PHRASE`` words in them; any window inside a passage holds one of them whole.
4. All documents of the shard stream through the automaton. A hit is extended word by word as far as
   document and passage agree, and a stretch of a window or more is removed.

Counts are kept for each (hash, shard), so a window that all documents share has a row for each shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from seaglint.llm.common import give_back, prepare, slices

WINDOW, ANCHOR = 35, 8
#: Any window holds a phrase that starts at a multiple of PHRASE words, as 2 * PHRASE - 1 <= WINDOW.
PHRASE = (WINDOW + 1) // 2
#: Bytes of text in a shard, about; a longer document makes a larger one.
SHARD_BYTES = 2_000_000
#: Phrases of an automaton; the words of their passages (up to WINDOW a phrase) have to fit into the code points.
AUTOMATON = 30_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


LETTERS = re.compile("[^\0]{%d,}" % WINDOW)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def rolled(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``size`` words, put together from runs of powers of two."""
    out, done = None, 0
    power, run, scale = 1, words, base
    with np.errstate(over="ignore"):
        while True:
            if size & power:
                part = run[done:]
                if out is None:
                    out = part
                else:
                    n = min(len(out), len(part))
                    out = out[:n] * scale + part[:n]
                done += power
            power *= 2
            if power > size:
                return out[: max(0, len(words) - size + 1)]
            n = max(0, len(run) - power // 2)
            run = run[:n] * scale + run[power // 2 : power // 2 + n]
            scale = scale * scale


def first_least(h: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` entries the place of its smallest one, by the leading bits; the first of equal ones."""
    bits = np.uint64(len(h).bit_length())
    least, power = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * power <= size:
        least = np.minimum(least[:-power], least[power:])
        power *= 2
    if power < size:
        least = np.minimum(least[: len(h) - size + 1], least[size - power :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Texts:
    """Words of several texts put one after another, with the windows that lie inside one text."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        total = int(self.ends[-1]) if len(texts) else 0
        self.hash = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, total)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        #: Window starts, and the hash and place of the phrase that each picks.
        self.starts = np.flatnonzero(np.arange(total) + WINDOW <= self.ends[self.text]) if total else np.empty(0, np.int64)
        if len(self.starts):
            phrases = mix(rolled(self.hash, ANCHOR, BASES[0]))
            self.picked = first_least(phrases, WINDOW - ANCHOR + 1)[self.starts]
            self.anchors = phrases.view(np.int64)
        else:
            self.picked, self.anchors = np.empty(0, np.int64), np.empty(0, np.int64)

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit hash of the windows at ``starts``."""
        a = rolled(self.hash, WINDOW, BASES[0])[starts]
        b = rolled(mix(self.hash), WINDOW, BASES[1])[starts]
        return mix(a).view(np.int64), (mix(b) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row, and how often it occurs."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    at = np.flatnonzero(new)
    return np.minimum.reduceat(order, at) if len(at) else at, np.diff(np.append(at, len(order)))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def ordered(rows: pa.Table, text: str) -> tuple[list[bytes], pa.ChunkedArray | pa.Array]:
    """Texts of a shard in an order that does not depend on how its rows arrived, and the rows in that order."""
    held = rows.column("row").combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    texts = [t or b"" for t in held.field(text).cast(pa.binary()).to_pylist()]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return [texts[i] for i in order], held.take(pa.array(order, pa.int64()))


def candidates(texts: list[bytes], anchors: np.ndarray) -> pa.Table:
    """Distinct windows of a shard whose phrase recurs: hashes and first place, negative (~place) if there is another."""
    found = []
    first = 0
    for lo, hi in slices(texts):
        part = Texts(texts[lo:hi])
        if len(part.starts):
            new = np.flatnonzero(np.diff(part.picked, prepend=-1))
            recurs = np.isin(part.anchors[part.picked[new]], anchors)
            at = part.starts[np.repeat(recurs, np.diff(np.append(new, len(part.picked))))]
            a, b = part.windows(at)
            text = part.text[at]
            found.append((a, b, ((first + text) << 32) | (at - (part.ends - part.sizes)[text])))
        first += hi - lo
    kinds = (np.int64, np.int32, np.int64)
    a, b, place = (np.concatenate(side) for side in zip(*found)) if found else (np.empty(0, k) for k in kinds)
    at, n = unique_rows(a, b)
    return pa.table({"a": a[at], "b": b[at], "place": np.where(n > 1, ~place[at], place[at])})


def passages(texts: list[list[bytes]], places: np.ndarray) -> list[list[bytes]]:
    """Words of the passages that the windows at ``places`` (text and word number) make up."""
    places = np.sort(places)
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    out = []
    for run in np.split(places, cut) if len(places) else []:
        text, word = int(run[0]) >> 32, int(run[0]) & 0xFFFFFFFF
        out.append(texts[text][word : word + len(run) + WINDOW - 1])
    return out


def agreed_after(a: str, i: int, b: str, j: int) -> int:
    """How many characters are the same from ``a[i]`` and ``b[j]`` on."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 32
    while step:
        n = min(step, most - done)
        if n and a[i + done : i + done + n] == b[j + done : j + done + n]:
            done += n
            step *= 2
        else:
            step = n // 2
    return done


def agreed_before(a: str, i: int, b: str, j: int) -> int:
    """How many characters are the same before ``a[i]`` and ``b[j]``."""
    most, done, step = min(i, j), 0, 32
    while step:
        n = min(step, most - done)
        if n and a[i - done - n : i - done] == b[j - done - n : j - done]:
            done += n
            step *= 2
        else:
            step = n // 2
    return done


class Automaton:
    """Finds the phrases of passages in texts; words are single code points of its alphabet."""

    def __init__(self, own: list[list[bytes]]):
        self.code: dict[bytes, str] = {}
        self.passages = ["".join(map(self.letter, words)) for words in own]
        self.found = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for number, words in enumerate(self.passages):
            for at in range(0, len(words) - PHRASE + 1, PHRASE):
                where.setdefault(words[at : at + PHRASE], []).append((number, at))
        for phrase, places in where.items():
            self.found.add_word(phrase, places)
        self.found.make_automaton()

    def letter(self, word: bytes) -> str:
        c = self.code.get(word)
        if c is None:
            n = len(self.code) + 1
            c = self.code[word] = chr(n if n < 0xD800 else n + 0x800)  # not the surrogates
        return c

    def cover(self, words: list[bytes], edge: np.ndarray) -> None:
        """Adds the stretches of a text that recur to ``edge``: +1 at their starts, -1 after their ends."""
        text = "".join(map(self.code.get, words, repeat("\0")))
        done: dict[tuple[int, int], int] = {}
        # A window that recurs has words of passages only; shorter runs of them hold none.
        runs = (self.found.iter(text, run.start(), run.end()) for run in LETTERS.finditer(text))
        for end, places in chain.from_iterable(runs):
            hit = end - PHRASE + 1
            for number, at in places:
                line = (number, hit - at)
                if done.get(line, -1) >= end:
                    continue
                passage = self.passages[number]
                lo = hit - agreed_before(text, hit, passage, at)
                hi = end + 1 + agreed_after(text, end + 1, passage, at + PHRASE)
                done[line] = hi - 1
                if hi - lo >= WINDOW:
                    edge[lo] += 1
                    edge[hi] -= 1


def grouped(own: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Passages for one automaton after another."""
    held, phrases = [], 0
    for words in own:
        step = len(words) // PHRASE
        if held and phrases + step > AUTOMATON:
            yield held
            held, phrases = [], 0
        # A passage too long for one alphabet is cut; the pieces share a window less one word.
        size = AUTOMATON * PHRASE
        if len(words) > size:
            for at in range(0, len(words) - WINDOW + 1, size - WINDOW + 1):
                yield [words[at : at + size]]
            continue
        held.append(words)
        phrases += step
    if held:
        yield held


def removed(texts: list[bytes], places: np.ndarray) -> tuple[list[int], list[int], list[str]]:
    """n_words, n_removed and the kept words (joined by one space) of each text of a shard."""
    words = [t.split() for t in texts]
    edges = {}
    own = passages(words, places)
    for some in grouped(own):
        automaton = Automaton(some)
        for i, w in enumerate(words):
            if len(w) >= WINDOW:
                automaton.cover(w, edges.setdefault(i, np.zeros(len(w) + 1, np.int32)))
    n, gone, kept = [], [], []
    for i, w in enumerate(words):
        keep = w
        if i in edges and edges[i].any():
            inside = np.cumsum(edges[i][:-1]) > 0
            keep = [x for x, out in zip(w, inside.tolist()) if not out]
        n.append(len(w))
        gone.append(len(w) - len(keep))
        kept.append(b" ".join(keep).decode("utf-8"))
    return n, gone, kept


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (string, the kept words joined by one space).

    A word goes if some window of ``WINDOW`` words over it also starts anywhere else, in another row or in
    the same text. Null and empty texts have no words. Repeated rows recur and lose such words like other
    copies. Input columns with the names added are replaced.
    """
    prepare(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    shards = max(1, round(total / shard_bytes))
    rows = docs.select(
        shard_of(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), shards).alias("shard"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
    )
    texts = rows.select("shard", F.coalesce(F.encode(F.col(f"row.`{text_col}`"), "utf-8"), F.lit(b"")).alias("bytes"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, shard = b.column("bytes").to_pylist(), b.column("shard").to_numpy()
            for lo, hi in slices(held):
                part = Texts(held[lo:hi])
                at = part.picked[np.flatnonzero(np.diff(part.picked, prepend=-1))]
                anchor, own = part.anchors[at], shard[lo:hi][part.text[at]]
                first, n = unique_rows(anchor, own)
                yield batch(anchor=anchor[first], shard=own[first], n=n.astype(np.int64))

    picked = texts.mapInArrow(pick, "anchor long, shard int, n long").groupBy("anchor", "shard").agg(F.sum("n").alias("n"))
    recurring = picked.select("anchor", "shard", F.sum("n").over(Window.partitionBy("anchor")).alias("all")).where("`all` > 1").select("shard", "anchor")

    def propose(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = candidates(ordered(left, text_col)[0], right.column("anchor").to_numpy())
        give_back()
        return found.append_column("shard", pa.array([key[0].as_py()] * len(found), pa.int32()))

    proposed = rows.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(propose, "a long, b int, place long, shard int")
    times = F.when(F.col("place") < 0, 2).otherwise(1)
    confirmed = proposed.select("shard", "place", F.sum(times).over(Window.partitionBy("a", "b")).alias("all")).where("`all` > 1")
    confirmed = confirmed.select("shard", F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("place"))

    def locate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held, own = ordered(left, text_col)
        n, gone, kept = removed(held, right.column("place").to_numpy())
        give_back()
        return pa.table({"row": own, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    out = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    located = rows.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(locate, out)
    return located.select(*[f"row.`{c}`" for c in columns], "n_words", "n_removed", "kept")
