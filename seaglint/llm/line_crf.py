"""Quality rules by line labelling: a linear-chain conditional random field marks content and boilerplate.

Each line with a word is described by a few counts. The field scores how each label fits a line and how
labels follow each other; Viterbi decoding gives the best sequence for a text, and the share of its words
that stand in content lines decides whether it is kept. Weights start from rule weights and are trained on
documents labelled good or poor: lines of good documents are content; lines of poor ones start as
boilerplate and are labelled anew by the model in each round, as a poor document may have good lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import map_texts

FEATURES = ("bias", "symbols", "symbol words", "capitals", "digits", "long words", "few words", "seen line", "repeated words", "open end")
#: Rule weights of the label boilerplate; content has the opposite.
RULES = np.array([-2.0, 8.0, 2.0, 2.0, 2.0, 0.2, 0.3, 1.5, 2.0, 0.2])
#: Weights of staying in a label and of changing it.
STAY = np.array([0.5, 0.5])
#: Most labelled documents that the field is fitted on, all of their lines, and lines of a run.
FIT_DOCS, RUN_LINES = 2_000, 128
ROUNDS, STEPS, RATE, PRIOR = 3, 80, 0.12, 0.02
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED = 10, 20

SYMBOLS = b"#*$%&|<>"
MARKS = SYMBOLS + b"!{}[]\\^~=_@+"
CAPITALS = bytes(range(0x41, 0x5B))
LETTERS = CAPITALS + bytes(range(0x61, 0x7B))
DIGITS = b"0123456789"
BLANKS = b" \t\n\x0b\x0c\r"
FOLLOWERS = bytes(range(0x80, 0xC0))  # all bytes of a code point but the first
END = tuple(b".!?:;\"')".decode())


def less(text: bytes, drop: bytes) -> int:
    """How many bytes of ``drop`` the text has."""
    return len(text) - len(text.translate(None, drop))


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """One row for each line that has a word."""
    seen, rows = set(), []
    for line, own in zip(lines, words):
        n = len(own)
        chars = len(line.translate(None, BLANKS + FOLLOWERS))
        letters = less(line, LETTERS)
        marked = sum(1 for w in own if w.translate(None, MARKS) != w)
        rows.append(
            (
                1.0,
                min(1.0, 5 * less(line, MARKS) / chars),
                marked / n,
                less(line, CAPITALS) / letters if letters else 0.0,
                less(line, DIGITS) / chars,
                max(0.0, chars / n - 12) / 12,
                1.0 if n < 4 else 0.0,
                1.0 if line in seen else 0.0,
                1 - len(set(own)) / n,
                0.0 if own[-1][-1:].decode("latin-1") in END else 1.0,
            )
        )
        seen.add(line)
    return np.array(rows).reshape(-1, len(FEATURES))


def worded_lines(text: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    lines = text.split(b"\n")
    words = [x.split() for x in lines]
    kept = [i for i, w in enumerate(words) if w]
    return [lines[i] for i in kept], [words[i] for i in kept]


class Field:
    """Weights: ``emit`` of boilerplate against content, ``move[a, b]`` from label a to b (0 content, 1 boilerplate)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = RULES.copy() if emit is None else emit
        self.move = np.diag(STAY) if move is None else move

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best label of each line."""
        score = features @ self.emit
        (stay0, to1), (to0, stay1) = self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for i, s in enumerate(score.tolist()):
            if i:
                from1 = b + to0 > a + stay0
                from1_too = b + stay1 > a + to1
                a, b = max(a + stay0, b + to0), max(a + to1, b + stay1)
                back.append((from1, from1_too))
            a, b = a - s / 2, b + s / 2
        labels = np.zeros(len(score), np.int8)
        if len(score):
            now = int(b > a)
            labels[-1] = now
            for i in range(len(score) - 2, -1, -1):
                now = int(back[i][now])
                labels[i] = now
        return labels

    def gradient(self, runs: Runs, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log-likelihood of runs of lines with the labels ``y``."""
        half = (runs.x @ self.emit) / 2
        unary = np.stack([-half, half], axis=1)
        ahead = unary.copy()
        for t in range(1, runs.length):
            now, before = runs.at(t)
            ahead[now] += np.logaddexp(ahead[before, 0, None] + self.move[0], ahead[before, 1, None] + self.move[1])
        total = np.logaddexp(*ahead[runs.last].T)
        behind, prob, moves = np.zeros((len(total), 2)), np.empty(len(unary)), np.zeros((2, 2))
        for t in range(runs.length - 1, -1, -1):
            now, before = runs.at(t)
            m = runs.active[t]
            prob[now] = np.exp(ahead[now, 1] + behind[:m, 1] - total[:m])
            if t:
                reach = self.move + (unary[now] + behind[:m])[:, None, :]
                moves += np.exp(ahead[before, :, None] + reach - total[:m, None, None]).sum(axis=0)
                behind[:m] = np.logaddexp(reach[:, :, 0], reach[:, :, 1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[runs.before], y[runs.after]), 1)
        return (y - prob) @ runs.x / len(y), (seen - moves) / len(y)


class Runs:
    """Runs of lines, longest first, packed place by place: the first lines of all runs, then the second ones, and so on."""

    def __init__(self, features: list[np.ndarray]):
        self.order = sorted(range(len(features)), key=lambda i: -len(features[i]))
        sizes = np.array([len(features[i]) for i in self.order])
        self.length = int(sizes.max())
        #: Runs that have a line at each place.
        self.active = [int((sizes > t).sum()) for t in range(self.length)]
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        #: Where the lines of each run stand.
        self.places = [self.starts[:n] + row for row, n in enumerate(sizes)]
        self.x = np.empty((int(sizes.sum()), len(FEATURES)))
        for i, own in zip(self.order, self.places):
            self.x[own] = features[i]
        self.last = np.array([own[-1] for own in self.places])
        self.before = np.concatenate([own[:-1] for own in self.places])
        self.after = np.concatenate([own[1:] for own in self.places])

    def at(self, t: int) -> tuple[slice, slice]:
        """The lines at place ``t``, and those of the same runs at the place before."""
        m, lo = self.active[t], self.starts[t]
        before = self.starts[t - 1] if t else 0
        return slice(lo, lo + m), slice(before, before + m)


def fit(features: list[np.ndarray], poor: list[bool]) -> Field:
    """A field for documents' line features and whether each document is poor; rule weights where a class lacks.

    All lines of a document count. A long document is cut to runs of ``RUN_LINES`` lines, as the steps of the
    fit grow with the longest run; only how labels follow each other at a cut is not learned.
    """
    field = Field()
    kept = [i for i, f in enumerate(features) if len(f)]
    bad = np.array([poor[i] for i in kept], bool)
    if not bad.any() or bad.all():
        return field
    cut = [(features[i][lo : lo + RUN_LINES], poor[i]) for i in kept for lo in range(0, len(features[i]), RUN_LINES)]
    runs = Runs([x for x, _ in cut])
    y = np.zeros(len(runs.x), np.int64)
    bad_runs = [own for i, own in zip(runs.order, runs.places) if cut[i][1]]
    y[np.concatenate(bad_runs)] = 1
    for round_ in range(ROUNDS):
        if round_:
            for own in bad_runs:
                y[own] = field.viterbi(runs.x[own])
        state = [np.zeros_like(field.emit), np.zeros_like(field.emit), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, STEPS + 1):
            emit, move = field.gradient(runs, y)
            emit -= PRIOR * (field.emit - RULES) / len(RULES)
            move -= PRIOR * (field.move - np.diag(STAY)) / 4
            for k, g in ((0, emit), (2, move)):
                state[k] = 0.9 * state[k] + 0.1 * g
                state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            rate = lambda k: RATE * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)  # noqa: E731, B023
            field = Field(field.emit + rate(0), field.move + rate(2))
    return field


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Field:
    """The field fitted on at most ``FIT_DOCS`` labelled documents, those with the smallest hashes of their ids.

    Labels: 1 good, 0 poor; null labels and ids are left out. Only line features reach the driver, of all
    lines of these documents. Without documents of both kinds the rule weights hold.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_good")).dropna().groupBy("_id").agg(F.min("_good").alias("_good"))
    chosen = marks.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(FIT_DOCS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def describe(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        for found in runs:
            yield {"_x": [line_features(*worded_lines(t)).astype(np.float32).tobytes() for t in found]}

    rows = map_texts(texts, describe, "_x binary", "_text").select("_id", "_good", "_x").orderBy(F.md5(F.col("_id").cast("string")), "_x").limit(2 * FIT_DOCS).collect()
    return fit([np.frombuffer(r["_x"], np.float32).reshape(-1, len(FEATURES)).astype(float) for r in rows], [r["_good"] == 0 for r in rows])


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    bits = len(number).bit_length()
    n = len(words) - size + 1
    window = ids[:n].copy()
    room = bits
    for j in range(1, size):
        if room + bits > 62:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
            room = len(words).bit_length()
        window = (window << bits) | ids[j : j + n]
        room += bits
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge(text: bytes, field: Field, share: float = CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept of a text."""
    lines, words = worded_lines(text)
    flat = [w for own in words for w in own]
    n, repeated = len(flat), repeated_words(flat)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    labels = field.viterbi(line_features(lines, words))
    content = sum(len(own) for own, label in zip(words, labels) if not label) / n if n else 0.0
    return n, len(text.translate(None, BLANKS + FOLLOWERS)), less(text, SYMBOLS), len(lines) - len(set(lines)), repeated, failed, content, not failed and content >= share


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def quality_rules(docs: DataFrame, field: Field, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with the counts of each whole text, ``base_failed``, ``content_share`` and ``kept``.

    Words are runs without white space (``[^\\x20\\x09-\\x0D]+``). A text with fewer than ten words, null and
    empty ones too, fails. Input columns with these names are replaced; repeated rows stay.
    """
    names = [part.split()[0] for part in JUDGED.split(", ")]

    def run(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        for texts in runs:
            found = [judge(t, field, share) for t in texts]
            yield {name: [row[i] for row in found] for i, name in enumerate(names)}

    return map_texts(docs, run, JUDGED, text_col)
