"""Cross-tokenizer alignment: the tokens of two tokenizers cut into groups that cover the same bytes.

Every token points to its farthest-right overlapping token, of either side. The pointers of a run of
documents are one array, and doubling it (each pointer takes its target's pointer) converges to the last
token of each component after a logarithmic number of steps; that token labels the group.

Corpus counts of linked id pairs are looked up in two tiers: the most frequent pairs, as many as a fixed
bound allows, travel to the tasks as sorted arrays; the occurrences of the others are joined by pair.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import give_back, map_texts, materialise

#: Pairs whose counts travel to the tasks, at most; 13 bytes each.
TOP_PAIRS = 1 << 20
#: Kept pieces of text with their tokens, before a worker starts anew.
KEPT = 200_000
#: Keys that a task counts before it sends them on.
COUNTED = 4_000_000
#: A character before a space at which both tokenizers surely cut.
SAFE_END = regex.compile(r"[!-~\p{L}\p{N}]\Z")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and for each id its bytes and their number."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)

    def joined(self, ids) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class ByteLevelSide(Side):
    """A byte-level tokenizer of the tokenizers library; texts get a space in front, special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        vocabulary, byte = self.library.get_vocab(), byte_of()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(entries)
        pre = self.library.pre_tokenizer
        #: Whether a space after a character that is none always starts a new token.
        self.cuts_at_spaces = self.library.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(Side):
    """A sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts_at_spaces = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevelSide, PieceSide]:
    return ByteLevelSide(path_a), PieceSide(path_b)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, ``size`` numbers each, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Rows:
    """Lists of numbers of different lengths in one array."""

    def __init__(self):
        self.values, self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter((x for row in lists for x in row), np.int64, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, new])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after another, and how many each row has."""
        sizes = self.sizes[rows]
        return self.values[spread(self.starts[rows], sizes)], sizes


class Tokens:
    """Tokens of both sides for texts, as the libraries give them for whole texts.

    A text is cut where a space follows a letter, digit or ASCII sign, as both tokenizers cut there; the
    tokens of a piece between two cuts are kept and used again.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.cuts = a.cuts_at_spaces and b.cuts_at_spaces
        self.start()

    def start(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b, self.good = Rows(), Rows(), np.empty(0, bool)

    def pieces(self, text: str) -> list[str]:
        """What stands between the cuts, each without its first space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if all(map(self.known.__contains__, parts)):
            return parts  # whatever was kept ends safely
        out, open_end = [], False
        for part in parts:
            if open_end:
                out[-1] += " " + part
            else:
                out.append(part)
            open_end = part not in self.known and not SAFE_END.search(part)
        if open_end and len(out) > 1:
            last = out.pop()
            out[-1] += " " + last
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of A and how many each text has, the same of B, and whether the bytes of both are space and text.

        Texts that are not good have no ids.
        """
        if len(self.known) > KEPT:
            self.start()
        cut = [self.pieces(t) if t else [] for t in texts]
        found: dict[str, int] = {}
        new = [p for p in dict.fromkeys(p for row in cut for p in row) if p not in self.known]
        at = len(self.good)
        for i, p in enumerate(new):
            (self.known if SAFE_END.search(p) and len(p) <= 64 else found)[p] = at + i
        ids_a, ids_b = self.a.ids(new), self.b.ids(new)
        whole = [(" " + p).encode() for p in new]
        good = np.array([self.a.joined(x) == w == self.b.joined(y) for x, y, w in zip(ids_a, ids_b, whole)], bool)
        self.ids_a.add(ids_a)
        self.ids_b.add(ids_b)
        self.good = np.concatenate([self.good, good])
        get, other = self.known.get, found.get
        rows = np.array([r if (r := get(p)) is not None else other(p) for row in cut for p in row], np.int64)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        owner = np.repeat(np.arange(len(texts)), many)
        fine = many > 0
        for i in np.unique(owner[~self.good[rows]]):
            own = rows[owner == i]
            whole_text = (" " + texts[i]).encode()
            fine[i] = all(side.joined(ids.take(own)[0]) == whole_text for side, ids in ((self.a, self.ids_a), (self.b, self.ids_b)))
        rows, owner = rows[fine[owner]], owner[fine[owner]]
        out = []
        for ids in (self.ids_a, self.ids_b):
            values, sizes = ids.take(rows)
            out += [values, np.bincount(owner, sizes, len(texts)).astype(np.int64)]
        return *out, fine


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A, then of B, the A token that ends its group, by pointer jumping.

    Both sides cover the same bytes without gaps; ends ascend. A token points to the farthest-right token
    that overlaps it: itself, or the last one of the other side that starts before its end. Of tokens with
    the same end A's is the farther one, so a chain ends at the A token where both sides end.
    """
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    last_b = np.searchsorted(start_b, end_a, "left") - 1
    last_a = np.searchsorted(start_a, end_b, "left") - 1
    to = np.concatenate([np.where(end_b[last_b] > end_a, len(end_a) + last_b, np.arange(len(end_a))), last_a])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[: len(end_a)], to[len(end_a) :]
        to = farther


class Words:
    """Ids as text with the sign that follows them."""

    def __init__(self, a: Side, b: Side):
        made = lambda side, sign: np.array([f"{i}{sign}" for i in range(len(side.entries))], object)
        self.inner = made(a, ","), made(b, ",")
        self.last = made(a, "|"), made(b, ";")


def align(tokens: Tokens, words: Words, texts: list[str]) -> dict[str, list]:
    """Counts, digest of the groups, and distinct linked pairs with their number, of each text.

    ``pairs`` has the pairs as numbers (A id times entries of B, plus B id), ascending, 32 or 64 bits each;
    ``times`` a byte for each, a pair that is met more than 255 times stands several times.
    """
    a, n_a, b, n_b, _ = tokens.of(texts)
    n = len(texts)
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    zero = [0] * n
    if not len(a):
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups_sha256": [""] * n, "pairs": [b""] * n, "times": [b""] * n}
    end_a, end_b = np.cumsum(tokens.a.lengths[a]), np.cumsum(tokens.b.lengths[b])
    to_a, to_b = terminals(end_a, end_b)
    ends = to_a == np.arange(len(a))
    number = np.cumsum(ends) - 1
    group_a, group_b = number[to_a], number[to_b]
    groups = np.bincount(doc_a, ends, n).astype(np.int64)

    # Groups as text: A's ids of a group, then B's.
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    out = np.empty(len(a) + len(b), object)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = np.where(ends, words.last[0][a], words.inner[0][a])
    out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = np.where(last_b, words.last[1][b], words.inner[1][b])
    written, stop = out.tolist(), np.cumsum(n_a + n_b).tolist()
    digests = [sha256("".join(written[lo:hi])[:-1].encode()).hexdigest() if hi > lo else "" for lo, hi in zip([0, *stop], stop)]

    # Links: the B tokens from the first that ends after A's start to the last that starts before A's end.
    first = np.searchsorted(end_b, end_a - tokens.a.lengths[a], "right")
    many = np.searchsorted(end_b - tokens.b.lengths[b], end_a, "left") - first
    pair = np.repeat(a * len(tokens.b.entries), many) + b[spread(first, many)]
    doc = np.repeat(doc_a, many)
    links = np.bincount(doc, minlength=n)
    size = len(tokens.a.entries) * len(tokens.b.entries)
    keys, times = np.unique(doc * size + pair, return_counts=True)
    repeats = (times + 254) // 255
    if len(times) and repeats.max() > 1:
        keys = np.repeat(keys, repeats)
        nth = spread(np.zeros(len(repeats), np.int64), repeats)
        times = np.minimum(np.repeat(times, repeats) - 255 * nth, 255)
    at = np.searchsorted(keys, np.arange(n + 1) * size)
    packed, counts = (keys % size).astype(pair_type(tokens.a, tokens.b)), times.astype(np.uint8)
    cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return {
        "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": groups.tolist(), "n_links": links.tolist(), "groups_sha256": digests,
        "pairs": [packed[lo:hi].tobytes() for lo, hi in cut], "times": [counts[lo:hi].tobytes() for lo, hi in cut],
    }


def pair_type(a: Side, b: Side) -> type:
    return np.uint32 if len(a.entries) * len(b.entries) <= 1 << 32 else np.uint64


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each whole text, see ``align``."""

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        a, b = sides(path_a, path_b)
        tokens, words = Tokens(a, b), Words(a, b)
        for texts in runs:
            yield align(tokens, words, [t.decode() for t in texts])

    return map_texts(docs, run, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary", text_col)


def pair_counts(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has more), over the rows of ``aligned``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pair_type(*sides(path_a, path_b))
        held, sums, rows = [], [], 0

        def merged():
            keys, at = np.unique(np.concatenate(held), return_inverse=True)
            return keys, np.bincount(at, np.concatenate(sums)).astype(np.int64)

        def sent():
            keys, n = merged()
            for lo in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)].astype(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            # A pair that stands several times in a document counts once.
            own = [np.frombuffer(x, kind) for x in batch.column("pairs").to_pylist() if x]
            if not own:
                continue
            own = np.concatenate([x if (x[1:] != x[:-1]).all() else np.unique(x) for x in own])
            keys, n = np.unique(own, return_counts=True)
            held.append(keys)
            sums.append(n)
            rows += len(keys)
            if rows > COUNTED:
                keys, n = merged()
                held, sums, rows = [keys], [n], len(keys)
                if rows > COUNTED // 2:
                    yield from sent()
                    held, sums, rows = [], [], 0
        if held:
            yield from sent()
        give_back()

    entries_b = len(sides(path_a, path_b)[1].entries)
    counted = materialise(found.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    of_a = F.floor(F.col("pair") / F.lit(entries_b)).cast("int")
    best = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", of_a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def top_pairs(counts: DataFrame, most: int = TOP_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, n and best of all pairs from a count on, at most ``most`` of them, by ascending pair."""
    # Counts in steps of an eighth of a doubling: a few hundred rows.
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).orderBy(F.desc("step")).collect():
        held += r["pairs"]
        if held > most:
            break
        least = r["step"]
    rows = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    order = np.argsort(rows.column("pair").to_numpy())
    return tuple(rows.column(c).to_numpy()[order] for c in ("pair", "n", "best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id", most: int = TOP_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each row of ``docs``.

    Side A is a byte-level tokenizer file that gets a space before the text, side B a sentencepiece model.
    Null and empty texts, and texts that either side does not give back byte for byte, have zeros and an
    empty digest. Repeated rows and null ids keep their rows, and each counts as a document. Other columns
    of ``docs`` are not looked at. Equal counts of an A id are all its highest.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialise(aligned(texts, path_a, path_b).drop("text").withColumn("row", F.monotonically_increasing_id()))
    counts = materialise(pair_counts(found, path_a, path_b))
    table = docs.sparkSession.sparkContext.broadcast(top_pairs(counts, most))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pair_type(*sides(path_a, path_b))
        top, n, best = table.value
        for batch in batches:
            own = [np.frombuffer(x, kind) for x in batch.column("pairs").to_pylist()]
            pair = np.concatenate([*own, np.empty(0, kind)]).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(own)), [len(x) for x in own])
            at = np.minimum(np.searchsorted(top, pair), max(len(top) - 1, 0))
            hit = top[at] == pair if len(top) else np.zeros(len(pair), bool)
            at, seen, of = at[hit], times[hit], row[hit]
            sums, bests = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            if len(at):
                np.add.at(sums, of, seen * n[at])
                np.add.at(bests, of, seen * best[at])
            ends = np.searchsorted(row[~hit], np.arange(len(own) + 1)).astype(np.int32)
            missed = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], names=["pair", "times"])
            kept = [batch.column(c) for c in OWN]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(ends, missed)], names=[*OWN, "n_best", "count_sum", "missed"])
        give_back()

    kind = found.schema["id"].dataType.simpleString()
    shape = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, missed array<struct<pair:bigint,times:bigint>>"
    looked = materialise(found.mapInArrow(look_up, shape))
    rare = looked.select("row", F.explode("missed").alias("m")).select("row", "m.pair", "m.times")
    joined = rare.join(counts.hint("merge"), "pair")
    more = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = looked.drop("missed").join(more, "row", "left")
    return whole.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


OWN = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
