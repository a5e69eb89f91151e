"""Token counts by a two-tier lookup: a broadcast table of frequent pre-token lengths, then worker caches.

The text is cut into pre-tokens as the byte-level tokenizer cuts it. The lengths of frequent pre-tokens
come from a broadcast hash table of bounded size, the others from a cache in each worker that asks the
library once for each miss. No pre-token is shuffled. The table is fitted on a bounded sample of documents
and only saves time: a pre-token has the same length in either tier.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import map_texts, prepare

#: The public pattern of byte-level tokenizers; whoever names ``use_regex`` means it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the broadcast table; about 4 MB.
TABLE_SIZE = 65_536
#: Documents, at most about, that the table is fitted on.
SAMPLE_DOCS = 4_000
#: Entries of a worker's cache, before it starts anew.
CACHE_SIZE = 400_000
#: Pre-tokens longer than this are not kept.
LONGEST_KEPT = 64


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Lengths:
    """Token counts of texts for one tokenizer file; lives as long as a task."""

    def __init__(self, path: str, table: dict[str, int]):
        self.path, self.table = path, table
        self.library = tokenizer(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Whether the pattern cuts as the tokenizer does; if not, the library gets whole texts.
        self.plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile(PATTERN).findall
        self.seen: set[str] = set()
        self.doubtful: set[str] = set()
        self.cache: dict[str, int] = {}

    def agreed(self, char: str) -> bool:
        """Whether the library and the pattern put the character in the same class."""
        one = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
        theirs = "L" if one("a" + char) else "N" if one("1" + char) else "O" if one("!" + char) else "S"
        ours = "L" if regex.match(r"\p{L}", char) else "N" if regex.match(r"\p{N}", char) else "S" if regex.match(r"\s", char) else "O"
        return ours == theirs

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens; None if only the library can tell."""
        if not self.plain or any(s in text for s in self.special):
            return None
        if not text.isascii() or self.doubtful:
            chars = set(text)
            for c in chars - self.seen:
                self.seen.add(c)
                if not self.agreed(c):
                    self.doubtful.add(c)
            if not self.doubtful.isdisjoint(chars):
                return None
        return self.cut(text)

    def length(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST_KEPT:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        found = self.pieces(text)
        if found is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total, missed = 0, []
        for n, piece in zip(map(self.table.get, found), found):
            if n is None:
                missed.append(piece)
            else:
                total += n
        get, length = self.cache.get, self.length
        for piece in missed:
            total += get(piece) or length(piece)
        return total


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS, text_col: str = "text") -> dict[str, int]:
    """Pre-token lengths for the broadcast table: the most frequent of a random sample of documents."""
    prepare(docs.sparkSession)
    rows = docs.count()
    part = docs.select(F.col(text_col).alias("text")).where("text is not null").sample(min(1.0, sample_docs / max(rows, 1)), 7)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = Lengths(path, {}), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(p for p in lengths.pieces(text) or () if len(p) <= LONGEST_KEPT)
            if len(seen) > 8 * size:
                seen = Counter(dict(seen.most_common(size)))
        kept = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["piece", "n"])

    counted = part.mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(size).collect()]
    library = tokenizer(path)
    return {p: len(library.encode(p, add_special_tokens=False).ids) for p in top}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text", size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each whole text.

    Counts are those of the tokenizer library, special strings in a text handled as its default. Null and
    empty texts have none of either. Input columns with these names are replaced; repeated rows stay.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, size, sample_docs, text_col))

    def count(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        lengths = Lengths(path, table.value)
        for texts in runs:
            n = [lengths.count(t.decode("utf-8")) for t in texts]
            yield {"n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean", text_col)
