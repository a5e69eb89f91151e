"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes picks cut marks; a chunk ends before the first white space after a mark, so
equal passages of different documents have equal chunks whatever stands around them. A worker encodes
each chunk once and keeps it; a new chunk takes the ids of words seen before from a word cache and asks
the library for the others, since white space separates words for these tokenizers. Where two chunks join, the words on both sides are encoded together and must
agree with what the chunks say; if they do not, the stretch is widened until it agrees, in the end to
both chunks, which then become one.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame

from seaglint.llm.common import map_texts
from seaglint.llm.token_counts import tokenizer

#: Bytes that the rolling hash covers, and a mark for each 2**MARK_BITS bytes on average.
WINDOW, MARK_BITS = 8, 9
#: Chunks and joins that a worker keeps, in two generations each, and words (of those that it meets again).
KEPT, KEPT_WORDS = 10_000, 400_000
#: A control character, alone one token; and how many pieces a line for the library has.
MARK, LINE = b"\x01", 500
BETWEEN = b" " + MARK + b" "
SPACES = (0x20, 0x0A, 0x09, 0x0D, 0x0B, 0x0C)
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
IS_SPACE = np.isin(np.arange(256), SPACES)


def cuts(text: bytes) -> list[int]:
    """Where chunks end, the text's end included; every other cut stands before white space."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < WINDOW:
        return [len(data)] if len(data) else []
    geared = GEAR[data]
    rolled = geared[WINDOW - 1 :].copy()
    for j in range(1, WINDOW):
        rolled += geared[WINDOW - 1 - j : len(data) - j] << np.uint32(j)
    marks = np.flatnonzero((rolled >> np.uint32(32 - MARK_BITS)) == 0) + WINDOW
    spaces = np.flatnonzero(IS_SPACE[data])
    at = np.searchsorted(spaces, marks)
    ends = np.unique(spaces[at[at < len(spaces)]])
    return [*ends[ends > 0].tolist(), len(data)]


class Generations:
    """A cache of bounded size: what was not asked for in a generation goes with it."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        if key in self.young:
            return self.young[key]
        if key in self.old:
            return self.put(key, self.old[key])
        return None

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


def last_words(chunk: bytes, n: int) -> bytes:
    """The last ``n`` words with the white space before them; the chunk itself if it has no more."""
    at = len(chunk.rstrip())
    for _ in range(n):
        at = max(chunk.rfind(bytes([s]), 0, at) for s in SPACES)
        if at <= 0:
            return chunk
    return chunk[at:]


def first_words(chunk: bytes, n: int) -> bytes:
    """White space and the first ``n`` words; the chunk itself if it has no more."""
    parts = chunk.split(None, n)
    return chunk[: len(chunk) - len(parts[n])].rstrip() if len(parts) > n else chunk


class ChunkEncoder:
    """Ids of texts by chunks; a worker keeps it from task to task."""

    def __init__(self, path: str, kept: int = KEPT, cut=cuts):
        self.library, self.cut = tokenizer(path), cut
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.chunks, self.joins = Generations(kept), Generations(kept)
        self.words: dict[bytes, tuple] = {}
        self.met = bytearray(1 << 22)
        (self.mark,) = self.library.encode(MARK.decode(), add_special_tokens=False).ids
        #: One object for each id, which the cached words share.
        self.numbers = list(range(self.library.get_vocab_size(with_added_tokens=True)))
        #: What joins tokens without a decoder, as the library does then.
        self.token = [self.library.id_to_token(i) or "" for i in self.numbers]
        self.joins_tokens = json.loads(self.library.to_str())["decoder"] is None
        self.encoded = self.widened = 0

    def library_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces go to the library in lines, with a mark of known id between them."""
        out: list[list[int]] = []
        lines = [pieces[at : at + LINE] for at in range(0, len(pieces), LINE)]
        joined = [BETWEEN.join(line) for line in lines]
        odd = [text.count(MARK) >= len(line) or any(s in text for s in self.special) for line, text in zip(lines, joined)]
        found = iter(self.library.encode_batch([t.decode("utf-8") for t, o in zip(joined, odd) if not o], add_special_tokens=False))
        for line, o in zip(lines, odd):
            if o:  # some piece has the mark or a special string
                out += map(self.whole, line)
                continue
            ids = next(found).ids
            at = 0
            for _ in range(len(line) - 1):
                end = ids.index(self.mark, at)
                out.append(ids[at:end])
                at = end + 1
            out.append(ids[at:])
        return out

    def whole(self, text: bytes) -> list[int]:
        return self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids

    def new_words(self, missing: list[bytes]) -> dict[bytes, tuple]:
        """Ids of words that the cache lacks; it takes those met before, while it has room."""
        number = self.numbers.__getitem__
        new = {w: tuple(map(number, ids)) for w, ids in zip(missing, self.library_ids(missing))}
        if len(self.words) < KEPT_WORDS:
            met = self.met
            for w in missing:
                place = hash(w) & (len(met) - 1)
                if met[place]:
                    self.words[w] = new[w]
                met[place] = 1
        return new

    def chunk_ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of new chunks, word by word; a chunk with a special string goes to the library."""
        special = [any(s in c for s in self.special) for c in chunks]
        worded = [[] if odd else c.split() for c, odd in zip(chunks, special)]
        words = list(chain.from_iterable(worded))
        found = list(map(self.words.get, words))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        new = self.new_words(list({words[i] for i in lacking}))
        for i in lacking:
            found[i] = new[words[i]]
        ends = list(accumulate(map(len, worded)))
        return [self.whole(c) if odd else list(chain.from_iterable(found[end - len(own) : end])) for c, odd, own, end in zip(chunks, special, worded, ends)]

    def fill(self, cache: Generations, wanted, encode) -> dict[bytes, list[int]]:
        """Ids of all wanted pieces; those that are not kept are encoded together, once each."""
        known = {w: cache.get(w) for w in wanted}
        missing = [w for w, ids in known.items() if ids is None]
        for w, ids in zip(missing, encode(missing)):
            known[w] = cache.put(w, ids)
        self.encoded += len(missing)
        return known

    @staticmethod
    def agrees(joined: list[int], left: list[int], right: list[int]) -> bool:
        """Whether ``joined`` is an end of ``left`` followed by a start of ``right``."""
        n = len(joined)
        return any(left[len(left) - k :] == joined[:k] and right[: n - k] == joined[k:] for k in range(1, n) if k <= len(left) and n - k <= len(right))

    def repair(self, left: bytes, left_ids: list[int], right: bytes, right_ids: list[int]) -> list[int] | None:
        """None if the chunks' ids may follow each other; else the ids of both chunks together."""
        n = 2
        while True:
            a, b = last_words(left, n), first_words(right, n)
            joined = self.whole(a + b)
            self.widened += 1
            if a == left and b == right:
                return None if joined == left_ids + right_ids else joined
            if self.agrees(joined, left_ids, right_ids):
                return None
            n *= 2

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included."""
        if self.joins_tokens:
            return " ".join(map(self.token.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        # The caches hold many small tuples and no cycles; looking for cycles takes a tenth of the time.
        watched = gc.isenabled()
        gc.disable()
        try:
            return self.encode_all(texts)
        finally:
            if watched:
                gc.enable()

    def encode_all(self, texts: list[bytes]) -> list[list[int]]:
        parted = []
        for t in texts:
            if any(s in t for s in self.special):
                parted.append([t])  # a special string is cut out before the rest is encoded
                continue
            ends = self.cut(t)
            parted.append([t[a:b] for a, b in zip([0, *ends], ends)])
        ids = self.fill(self.chunks, {c for parts in parted for c in parts}, self.chunk_ids)
        seams = {(a, b): last_words(a, 1) + first_words(b, 1) for parts in parted for a, b in zip(parts, parts[1:]) if ids[a] and ids[b]}
        joined = self.fill(self.joins, set(seams.values()), self.library_ids)
        out = []
        for parts in parted:
            whole: list[int] = []
            left, left_ids = b"", []
            for part in parts:
                part_ids = ids[part]
                if left_ids and part_ids and not ((left, part) in seams and self.agrees(joined[seams[left, part]], left_ids, part_ids)):
                    together = self.repair(left, left_ids, part, part_ids)
                    if together is not None:
                        left, left_ids = left + part, together
                        continue
                if not part_ids:
                    left += part
                    continue
                whole.extend(left_ids)
                left, left_ids = part, part_ids
            whole.extend(left_ids)
            out.append(whole)
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>): the token ids of each whole text, without added special tokens.

    Null and empty texts have no ids. An input column of that name is replaced; repeated rows stay.
    """

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        encoder = worker_encoder(path)
        for texts in runs:
            yield {"ids": encoder.encode(texts)}

    return map_texts(docs, run, "ids array<int>", text_col)


def decode(ids: list[int], path: str) -> str:
    """Text of ids, special tokens included."""
    return worker_encoder(path).decode(ids)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, and SHA-256 of the ids (decimal, joined by one space) and of the decoded text.

    Null and empty texts have no tokens and the digests of an empty text.
    """

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        encoder = worker_encoder(path)
        digits = [str(i) for i in range(encoder.library.get_vocab_size(with_added_tokens=True))]
        for texts in runs:
            found = encoder.encode(texts)
            yield {
                "n_tokens": [len(i) for i in found],
                "ids_sha256": [sha256(" ".join(map(digits.__getitem__, i)).encode()).hexdigest() for i in found],
                "decoded_sha256": [sha256(encoder.decode(i).encode()).hexdigest() for i in found],
            }

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)
