"""SimHash near-duplicates: popcounts of segments, a grid on them, exact verification.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings is at most the number of bits in which the fingerprints differ, so linked fingerprints (3 bits)
are at most 3 apart. Of four blocks of segments one then has no distance at all, and of four parts of the
other blocks again one: each fingerprint stands in 4 x 4 grid cells, named by the counts of a block and of
a part, and linked ones meet in at least one. Inside a cell the bits themselves decide.

Fingerprints are made distinct before they are dealt to cells, so copies meet nowhere. A cell gives a
spanning star for each of its connected groups, never all pairs; large cells are cut on by the counts of
their other segments, by the same argument.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seaglint.llm.common import map_texts, materialise
from seaglint.llm.links import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Shingles whose bits are counted at a time.
COUNTED = 65_536
#: Members of a cell that are compared shift by shift, and of one that is not cut on.
SHIFTS, LARGE = 32, 4_096


def simhash(text: bytes) -> int:
    """The fingerprint of a text, as a signed 64-bit number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    size = min(SHINGLE, len(words))
    spans = list(zip(starts[: len(words) - size + 1], ends[size - 1 :]))
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(spans), COUNTED):
        part = spans[lo : lo + COUNTED]
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        set_bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in the two bits of its segment."""
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def parts(counts: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Consecutive bit fields, lowest first."""
    out, at = [], 0
    for w in widths:
        out.append((counts >> np.uint64(at)) & np.uint64((1 << w) - 1))
        at += w
    return out


def cells(x: np.ndarray) -> np.ndarray:
    """The 16 cell numbers of each fingerprint: one row for each fingerprint."""
    out = []
    for b, (block, rest, _) in enumerate(blocks(segment_counts(x), 64)):
        for j, part in enumerate(parts(rest, [12] * 4)):
            out.append((np.uint64(4 * b + j) << np.uint64(28)) | (block << np.uint64(12)) | part)
    return np.stack(out, axis=1).astype(np.int64)


def widths(width: int) -> list[int]:
    """Four fields of whole segments that make up ``width`` bits."""
    segments = width // 2
    return [2 * (segments // 4 + (k < segments % 4)) for k in range(4)]


def blocks(counts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Each of the four blocks of ``width`` bits, with the other blocks put together and their width."""
    step = widths(width)
    fields = parts(counts, step)
    for b in range(4):
        rest, at = np.zeros_like(counts), 0
        for k in range(4):
            if k != b:
                rest |= fields[k] << np.uint64(at)
                at += step[k]
        yield fields[b], rest, at


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` things the smallest one reachable by the links ``a``-``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def group_links(x: np.ndarray, left: np.ndarray | None = None, width: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all members of a cell within ``BITS`` bits, as a spanning set.

    ``left`` has the segment counts that the cell does not fix, in ``width`` bits. A group that was reached
    is taken out at once, so dense cells cost little; sparse large ones are cut by the counts left.
    """
    if len(x) > LARGE and left is not None and width >= 8:
        found = []
        for block, rest, other in blocks(left, width):
            order = np.argsort(block, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if 1 < len(run) < len(x):
                    found.append(group_links(x[run], rest[run], other))
                elif len(run) == len(x):
                    return group_links(x)
        return tuple(np.concatenate(side) if found else np.empty(0, np.uint64) for side in (zip(*found) if found else ((), ())))
    froms, tos = [], []
    todo = x
    while len(todo) > 1:
        seed, todo, reach = todo[0], todo[1:], todo[:1]
        while len(reach) and len(todo):
            some, reach = reach[:32], reach[32:]
            near = (np.bitwise_count(todo[None, :] ^ some[:, None]) <= BITS).any(axis=0)
            if near.any():
                got = todo[near]
                froms.append(got)
                tos.append(np.full(len(got), seed))
                reach, todo = np.concatenate([reach, got]), todo[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (none, none)


def cell_links(cell: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole cells that stand one after another: cell numbers and fingerprints."""
    n = len(cell)
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.empty(0, int)
    size = np.diff(np.append(start, n))
    small = np.repeat(size <= SHIFTS, size)
    a, b = [np.empty(0, int)], [np.empty(0, int)]
    for d in range(1, min(SHIFTS, size.max() if n else 0)):
        at = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
        at = at[np.bitwise_count(x[at] ^ x[at + d]) <= BITS]
        a.append(at)
        b.append(at + d)
    a, b = np.concatenate(a), np.concatenate(b)
    used, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = stars(local[: len(a)], local[len(a) :], len(used))
    hung = np.flatnonzero(label != np.arange(len(used)))
    froms, tos = [x[used[hung]]], [x[used[label[hung]]]]
    for at, many in zip(start[size > SHIFTS], size[size > SHIFTS]):
        own = x[at : at + many]
        number = int(cell[at]) >> 28
        rest = list(blocks(segment_counts(own), 64))[number // 4][1]
        left = list(blocks(rest, 48))[number % 4][1]
        f, t = group_links(own, left, 36)
        froms.append(f)
        tos.append(t)
    return np.concatenate(froms), np.concatenate(tos)


def linked(fingerprints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) within ``BITS`` bits, enough to connect their groups."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cells(x).ravel()), pa.array(np.repeat(x, 16).view(np.int64))], names=["cell", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def links(cell, x):
            f, t = cell_links(cell, x)
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(t.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count < 65_536 or held[0][0][0] == held[-1][0][-1]:
                continue
            cell, x = (np.concatenate(side) for side in zip(*held))
            whole = np.searchsorted(cell, cell[-1])  # the last cell may go on
            yield links(cell[:whole], x[:whole])
            held, count = [(cell[whole:], x[whole:])], len(cell) - whole
        if held:
            yield links(*(np.concatenate(side) for side in zip(*held)))

    dealt = fingerprints.select("fp").mapInArrow(deal, "cell long, fp long")
    return dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, digest (MD5 of the text), fp, root and ``first``, the first (id, digest) of the group.

    Texts are lower-cased (A-Z) and cut to words ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have
    fingerprint 0, which is linked like any other. ``first`` is by ascending id, null ids last. One row for
    each row of ``docs``, repeated ones too.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        for found in runs:
            yield {"fp": [simhash(t) for t in found]}

    marked = materialise(map_texts(texts, run, "fp long", "text").select("id", "digest", "fp"))
    own = F.struct(F.col("id").isNull().alias("late"), "id", "digest")
    distinct = materialise(marked.groupBy("fp").agg(F.min(own).alias("first")))
    roots = components(linked(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root")
    return marked.join(named, "fp").select("id", "digest", "fp", "root", "first")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links."""
    found = near_groups(docs, text_col, id_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are the first of their group; of rows with the same id and text one stays."""
    found = near_groups(docs, text_col, id_col)
    kept = found.where((F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.digest") == F.col("digest"))).select("id", "digest").distinct()
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    rows = rows.select("_row", key.alias("_key")).join(kept.select(key.alias("_key")), "_key")
    return rows.dropDuplicates(["_key"]).select("_row.*")
