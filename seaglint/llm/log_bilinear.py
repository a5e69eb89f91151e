"""Language-model scores by a log-bilinear model, trained with noise-contrastive estimation.

Tokens are counted over all training texts. The most frequent ones that occur ``LEAST`` times or more are model
words of their own (as many as a broadcast table holds). All other words, of any number, are dealt by a hash to
shared signs with learned vectors; within such a sign a word has its share of the sign's count. So every word of
the corpus is predicted by the model, and also predicts what follows it.

The model predicts a token from the two before it: their vectors, weighted by place, add up to a prediction.
Signs are leaves of a tree of three levels: the most frequent ones hang at the root, the others in groups of
groups, about the cube root of their number in each. The prediction's products with the vectors of the children of
a node give the share of each child; so the three normalisers of a token are short sums, and exact. Every task
trains on its own texts from common starting values, against noise drawn from the shares of each level. Only
rows of values that a task moved are passed on, and averaged by the tokens seen.

Counts of frequent tokens are broadcast (a table of bounded size). Rare tokens meet their counts in a join,
so nothing that grows with the vocabulary is held by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seaglint.llm.common import materialise, prepare, slices

#: Signs that hang at the root of the tree, levels of the tree, and dimensions.
OWN, LEVELS, SIZE = 64, 3, 16
#: Sign of the end of a text (also what stands before a text).
END = 0
#: Most signs that words without a sign of their own share, and how many of them share one in a small corpus.
SHARED, SHARING = 16_384, 8
#: Occurrences in the training texts that make a token a model word, if it is in the broadcast table.
LEAST = 5
#: Pieces of the input that a training task reads one after another, as each task passes on the values it moved.
TOGETHER = 4
#: Rows of ``SIZE`` model values that are averaged together.
RANGE = 8_192
#: Predictions scored at a time.
SCORED = 2_048
#: Scores below this bound, of either sign, have exponentials that can be added up as they are.
SMALL = 70.0
#: Broadcast counts, and the longest token among them in bytes: at most 13 MB of tokens.
TABLE, TABLE_BYTES = 200_000, 64
#: Bytes of texts whose tokens a task counts at a time.
COUNTED_BYTES = 8_000_000
ROUNDS, NOISE, BATCH, RATE = 1, 64, 4_096, 0.3
FOLDS, HELD_OUT = 7, 2
END_TOKEN = b""


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the places of all tokens among these, one after another, and text sizes."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    met = words.flatten().dictionary_encode()
    kinds, at = met.dictionary.view(pa.binary()), met.indices.to_numpy().astype(np.int64)
    # Blanks at the ends of a text leave empty tokens there.
    whole = (pc.binary_length(kinds).to_numpy() > 0)[at]
    before = np.concatenate([[0], np.cumsum(whole)])
    return kinds, at[whole], np.diff(before[words.offsets.to_numpy()])


def bytes_of(kinds: pa.Array) -> list[bytes]:
    return kinds.to_numpy(zero_copy_only=False).tolist()


def token_counts(texts: DataFrame) -> DataFrame:
    """token (binary; the end of a text is empty) and c over the column ``bytes``."""

    def give(held: list[pa.Array]) -> pa.RecordBatch:
        kinds, at, sizes = cut(pa.concat_arrays(held))
        n = np.bincount(at, minlength=len(kinds))
        met = np.flatnonzero(n)
        tokens = pa.concat_arrays([kinds.take(pa.array(met)), pa.array([END_TOKEN], pa.binary())])
        return pa.RecordBatch.from_arrays([tokens, pa.array(np.append(n[met], len(sizes)))], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = b.column("bytes").cast(pa.binary())
            for lo, hi in slices(texts.to_pylist(), COUNTED_BYTES):
                run = texts.slice(lo, hi - lo)
                if held and size + run.nbytes > COUNTED_BYTES:
                    yield give(held)
                    held, size = [], 0
                held.append(run)
                size += run.nbytes
        if held:
            yield give(held)

    return texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` tokens have it or a larger one.

    Counts above 4096 are told apart by their leading twelve bits, so the histogram stays small.
    """
    extra = F.greatest(F.length(F.bin("c")) - 12, F.lit(0))
    level = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), extra), extra)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["level"]
    return least


def shared_signs(distinct: int) -> int:
    """Signs for words without one of their own, so that few words share one until there are ``SHARED``."""
    return min(SHARED, distinct // SHARING + 1)


class Vocabulary:
    """Frequent tokens: their counts and signs; what the words of each shared sign count together; totals.

    ``rows`` are the tokens of the table in descending order of counts. ``shared`` has the occurrences and the
    distinct words of all training tokens (but ends) by their shared sign; words of the table that have a sign
    of their own are taken off here.
    """

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int, ends: int, shared: np.ndarray):
        self.total, self.distinct, self.ends, self.signs = total, distinct, ends, shared.shape[1]
        self.number = {t: i for i, (t, _) in enumerate(rows)}
        self.count = np.array([c for _, c in rows] + [0], np.int64)
        self.n_own = int((self.count >= LEAST).sum())
        #: Sign of each token of the table.
        dealt = np.fromiter((crc32(t) % self.signs for t, _ in rows), np.int64, len(rows))
        self.word = 1 + self.n_own + dealt
        self.word[: self.n_own] = np.arange(1, 1 + self.n_own)
        held = np.bincount(dealt[: self.n_own], self.count[: self.n_own], self.signs), np.bincount(dealt[: self.n_own], minlength=self.signs)
        occurrences, kinds = shared[0] - held[0], shared[1] - held[1]
        #: What a word of a shared sign is divided by, as log10; an unseen word counts as one more.
        self.spread = np.log10(occurrences + kinds + 1)
        share = np.concatenate([[ends], self.count[: self.n_own], occurrences]) + 1.0
        self.share = share / share.sum()

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        end = F.sum(F.when(F.octet_length("token") == 0, F.col("c")))
        totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(end, F.lit(0)).alias("ends")).first()
        words = counts.where(F.octet_length("token") > 0)
        own = words.where(F.octet_length("token") <= TABLE_BYTES)
        top = own.where(F.col("c") >= least_frequent(own, TABLE)).orderBy(F.desc("c"), "token").toArrow()
        shared = np.zeros((2, shared_signs(totals["v"])), np.int64)
        by_sign = words.groupBy((F.crc32("token") % shared.shape[1]).alias("sign")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
        held = by_sign.toArrow()
        shared[:, held.column("sign").to_numpy()] = held.column("n").to_numpy(), held.column("v").to_numpy()
        return cls(list(zip(top.column("token").to_pylist(), top.column("c").to_pylist())), totals["n"], totals["v"], totals["ends"], shared)

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table numbers of all words one after another (-1: rare), signs with an end for each text, and text sizes."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = list(chain.from_iterable(texts))
        return *self.place(flat, np.arange(len(flat)), sizes), sizes

    def place(self, kinds: list[bytes], at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that were cut: each of their tokens is looked up once, wherever it stands."""
        found = np.fromiter(map(self.number.get, kinds, repeat(-1)), np.int64, len(kinds))
        signs = np.append(self.word, 0)[found]
        rare = np.flatnonzero(found < 0)
        signs[rare] = 1 + self.n_own + np.fromiter((crc32(kinds[i]) for i in rare.tolist()), np.int64, len(rare)) % self.signs
        words = np.full(len(at) + len(sizes), END)
        inside = np.ones(len(words), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        words[inside] = signs[at]
        return found[at], words


def contexts(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two places before each; END before the start of a text."""
    one, two = np.full(len(words), END), np.full(len(words), END)
    one[1:], two[2:] = words[:-1], words[:-2]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    one[starts] = two[starts] = END
    seconds = starts[sizes > 0] + 1
    two[seconds] = END
    return one, two


def log_sum(h: np.ndarray, output: np.ndarray, small: bool) -> np.ndarray:
    """Logarithm of the sum of the exponentials of all children's scores for each prediction.

    Predictions end in a 1, vectors in their bias. ``small`` says that no score is out of the range of exponentials, so that the largest need not be taken off.
    """
    scores = output @ h.T
    top = 0 if small else scores.max(axis=0)
    if not small:
        scores -= top
    np.exp(scores, out=scores)
    return top + np.log(np.ones(len(scores), np.float32) @ scores)


def moved(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sums of their gradients; most rows occur once and have nothing to add up."""
    order = np.argsort(rows)
    own = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    times = np.diff(starts, append=len(own))
    sums = grads.take(order[starts], axis=0)
    many = np.flatnonzero(times > 1)
    if len(many):
        again = grads.take(order[np.repeat(times > 1, times)], axis=0)
        sums[many] = np.add.reduceat(again, np.cumsum(times[many]) - times[many], axis=0)
    return own[starts], sums


class Model:
    """Vectors of context words, vectors and biases of the tree's nodes by level, and the weights of the two places.

    Nodes of the first level are the ``OWN`` first signs and the groups of groups; those of the second are groups,
    those of the third the other signs. Children of a node follow one another.
    """

    def __init__(self, share: np.ndarray, values: np.ndarray | None = None):
        self.share, self.n = share, len(share)
        self.own = min(self.n, OWN)
        rest = np.arange(self.n - self.own)
        self.group = max(2, int(np.ceil(np.cbrt(len(rest)))))
        #: The node of each sign by level; below the first level only of signs that do not hang at the root.
        self.paths = [np.concatenate([np.arange(self.own), self.own + rest // self.group**2]), rest // self.group, rest]
        tail = share[self.own :] / share[self.own :].sum() if len(rest) else share[:0]
        self.shares = [np.bincount(self.paths[0], share), np.bincount(self.paths[1], tail), tail]
        self.nodes = [len(s) for s in self.shares]
        if values is None:
            rng = np.random.default_rng(7)
            vectors = [rng.normal(0, 0.3, self.n * SIZE), rng.normal(0, 0.05, sum(self.nodes) * SIZE), np.full(2 * SIZE, 1.0)]
            values = np.concatenate([*vectors, *map(np.log, self.shares)])
        self.values = values.astype(np.float32)
        self.context, self.place, self.output, self.bias = self.split(self.values)

    def split(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Views of the values, or of what belongs to each of them: contexts, places, vectors and biases by level."""
        cut = np.split(values, np.cumsum([self.n * SIZE, *(n * SIZE for n in self.nodes), 2 * SIZE, *self.nodes[:-1]]))
        context, *output, place = (v.reshape(-1, SIZE) for v in cut[: LEVELS + 2])
        return context, place, output, cut[LEVELS + 2 :]

    def node(self, level: int, word: np.ndarray) -> np.ndarray:
        """Nodes of a level above (or at) these signs; below the first level they must not hang at the root."""
        return self.paths[level][word - self.own if level else word]

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, state: np.ndarray, rng) -> None:
        """A pass over the predictions, those alike put together, in batches of a random order."""
        code, weight = np.unique((two * self.n + one) * self.n + word, return_counts=True)
        order = rng.permutation(len(code))
        s_context, s_place, s_output, s_bias = self.split(state)
        steps = [np.cumsum(s) for s in self.shares]
        lifts = [np.log(NOISE * s).astype(np.float32) for s in self.shares]

        def step(values, state, rows, grad):
            s = state.take(rows, axis=0) + grad * grad
            state[rows] = s
            values[rows] = values.take(rows, axis=0) + RATE * grad / (np.sqrt(s) + 1e-6)

        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            rest, w = np.divmod(code[some], self.n)
            b, a = np.divmod(rest, self.n)
            mass = (weight[some] / weight[some].sum()).astype(np.float32)
            va, vb = self.context.take(a, axis=0), self.context.take(b, axis=0)
            h = np.ones((len(some), SIZE + 1), np.float32)
            h[:, :SIZE] = va * self.place[0] + vb * self.place[1]
            dh, changes, tail = np.zeros_like(va), [], np.flatnonzero(w >= self.own)
            for level in range(LEVELS):
                at = tail if level else slice(None)
                if level and not len(tail):
                    break
                noise = np.minimum(np.searchsorted(steps[level], rng.random(NOISE) * steps[level][-1], side="right"), self.nodes[level] - 1)
                more, rows, grad, slope = contrast(h[at], mass[at], self.node(level, w[at]), noise, self.output[level], self.bias[level], lifts[level])
                dh[at] += more
                changes += [(self.output[level], s_output[level], rows, grad), (self.bias[level], s_bias[level], rows, slope)]
            rows, grad = moved(np.concatenate([a, b]), np.concatenate([dh * self.place[0], dh * self.place[1]]))
            changes.append((self.context, s_context, rows, grad))
            changes.append((self.place, s_place, np.arange(2), np.stack([(dh * va).sum(axis=0), (dh * vb).sum(axis=0)])))
            for change in changes:
                step(*change)

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of words after their contexts."""
        order = np.argsort(word)
        word, one, two = word[order], one[order], two[order]
        h = np.ones((len(word), SIZE + 1), np.float32)
        h[:, :SIZE] = self.context.take(one, axis=0) * self.place[0]
        h[:, :SIZE] += self.context.take(two, axis=0) * self.place[1]
        first = np.searchsorted(word, self.own)
        found = np.zeros(len(word))
        longest = np.sqrt(np.einsum("ij,ij->i", h[:, :SIZE], h[:, :SIZE]).max(initial=0))
        for level, (vectors, bias) in enumerate(zip(self.output, self.bias)):
            output = np.append(vectors, bias[:, None], axis=1)
            start = first if level else 0
            node = self.node(level, word[start:])
            small = longest * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0)) + np.abs(bias).max(initial=0) < SMALL
            found[start:] += np.einsum("ij,ij->i", h[start:], output.take(node, axis=0))
            parent = self.node(level - 1, word[start:]) if level else np.zeros(len(word), np.int64)
            ends = [*np.flatnonzero(np.diff(parent)) + 1, len(parent)]
            for lo, hi in zip([0, *ends], ends):
                p = parent[lo] - (self.own if level == 1 else 0) if hi else 0
                children = slice(p * self.group, (p + 1) * self.group) if level else slice(None)
                for at in range(start + lo, start + hi, SCORED):
                    to = min(at + SCORED, start + hi)
                    found[at:to] -= log_sum(h[at:to], output[children], small)
        out = np.empty(len(word))
        out[order] = found / np.log(10)
        return out


@np.errstate(over="ignore")  # a score out of range makes a share of 0
def contrast(h, mass, word, noise, output, bias, lift) -> tuple[np.ndarray, ...]:
    """Noise-contrastive slopes: of the predictions, and of the vectors and biases of distinct rows.

    Predictions end in a 1, so that the slopes of biases are the last column of those of vectors.
    """
    out = output.take(word, axis=0)
    hit = mass / (1 + np.exp(np.einsum("ij,ij->i", h[:, :SIZE], out) + bias[word] - lift[word]))
    against = output.take(noise, axis=0)
    miss = h @ np.append(-against.T, (lift[noise] - bias[noise])[None], axis=0)
    np.exp(miss, out=miss)
    miss += 1
    np.divide(-mass[:, None], miss, out=miss)
    dh = hit[:, None] * out + miss @ against
    rows, grad = moved(np.concatenate([word, noise]), np.concatenate([hit[:, None] * h, miss.T @ h]))
    return dh, rows, grad[:, :SIZE], grad[:, SIZE]


def train(texts: DataFrame, vocabulary, rounds: int = ROUNDS) -> Model:
    """A model of the column ``bytes``; ``vocabulary`` is a broadcast Vocabulary.

    Texts are turned to model words once, four bytes each, which the rounds then read. The driver gets one
    averaged row for each ``SIZE`` values of the model, whatever the number of tasks.
    """
    spark = texts.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("bytes")
            for lo, hi in slices(held.to_pylist()):
                kinds, at, sizes = cut(held.slice(lo, hi - lo))
                _, words = vocabulary.value.place(bytes_of(kinds), at, sizes)
                yield pa.RecordBatch.from_arrays([pa.array([words.astype(np.uint32).tobytes()]), pa.array([sizes.tobytes()])], names=["words", "sizes"])

    numbered = materialise(texts.mapInArrow(number, "words binary, sizes binary"))
    pieces = numbered.rdd.getNumPartitions()
    numbered = numbered.coalesce(max(1, min(pieces, spark.sparkContext.defaultParallelism), pieces // TOGETHER))
    model = Model(vocabulary.value.share)
    rows_of = lambda values: np.append(values, np.zeros(-len(values) % SIZE, np.float32)).reshape(-1, SIZE)
    for round_ in range(rounds):
        shared = spark.sparkContext.broadcast(model.values)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            start = shared.value
            own = Model(vocabulary.value.share, start)
            state, rng, seen = np.full(len(start), 1e-4, np.float32), np.random.default_rng(round_), 0
            for b in batches:
                for held, counted in zip(b.column("words").to_pylist(), b.column("sizes").to_pylist()):
                    words, sizes = np.frombuffer(held, np.uint32).astype(np.int64), np.frombuffer(counted, np.int64)
                    own.learn(*contexts(words, sizes), words, state, rng)
                    seen += len(words)
            if seen:
                values = rows_of(own.values)
                at = np.flatnonzero((values != rows_of(start)).any(axis=1))
                for some in np.split(at, np.flatnonzero(np.diff(at // RANGE)) + 1):
                    yield pa.RecordBatch.from_arrays([pa.array([some[0] // RANGE]), pa.array([seen]), pa.array([some.astype(np.int32).tobytes()]), pa.array([values[some].tobytes()])], names=["range", "seen", "places", "held"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for k, seen, places, held in zip(*(b.column(c).to_pylist() for c in ("range", "seen", "places", "held"))):
                    sums, weight = total.setdefault(k, [np.zeros((RANGE, SIZE)), np.zeros(RANGE)])
                    at = np.frombuffer(places, np.int32) - k * RANGE
                    sums[at] += seen * np.frombuffer(held, np.float32).reshape(-1, SIZE).astype(float)
                    weight[at] += seen
            for k, (sums, weight) in total.items():
                at = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays([pa.array([(at + k * RANGE).astype(np.int32).tobytes()]), pa.array([(sums[at] / weight[at, None]).astype(np.float32).tobytes()])], names=["places", "held"])

        learned = numbered.mapInArrow(learn, "range long, seen long, places binary, held binary")
        values = rows_of(model.values)
        for r in learned.repartition("range").mapInArrow(average, "places binary, held binary").collect():
            values[np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["held"], np.float32).reshape(-1, SIZE)
        model = Model(vocabulary.value.share, values.ravel()[: len(model.values)])
        shared.unpersist()
    return model


def language_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut to words ``[^\\x20\\x09-\\x0D]+``, then one end. Held-out documents
    are not learned from. Null and empty texts are one end. With nothing to learn from, every token is
    unknown and the base score is 0. Rows with the same id and text are each returned.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b"")).alias("bytes"))
    learned = texts.where("not held_out").select("bytes")
    counts = materialise(token_counts(learned))
    vocabulary = spark.sparkContext.broadcast(Vocabulary.of(counts))
    model = train(learned, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((model.share, model.values))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        known = vocabulary.value
        logs = np.log10(known.count + 1.0)
        end_known = known.total > 0
        for b in batches:
            held = b.column("bytes")
            for lo, hi in slices(held.to_pylist()):
                n = hi - lo
                kinds, at, sizes = cut(held.slice(lo, n))
                found, words = known.place(bytes_of(kinds), at, sizes)
                text = np.repeat(np.arange(n), sizes)
                add = lambda v: np.bincount(text, v, n)  # noqa: B023, E731
                each = own.log10(*contexts(words, sizes), words)
                starts = np.cumsum(sizes + 1) - (sizes + 1)
                inside = np.delete(words, np.cumsum(sizes + 1) - 1)
                other = inside > known.n_own
                spread = np.where(other, known.spread[np.where(other, inside - 1 - known.n_own, 0)], 0.0)
                rare = found < 0
                met, times = np.unique(text[rare] * len(kinds) + at[rare], return_counts=True)
                first = b.column("id").slice(lo, hi - lo), b.column("key").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo)
                # A document's own row has a token that no text can have, so that it goes anywhere.
                whole = [*first, pa.array([b" %d" % k for k in first[1].to_pylist()], pa.binary()), pa.array([1] * n, pa.int64())]
                sums = (sizes + 1, add(found >= 0).astype(np.int64) + end_known)
                yield pa.RecordBatch.from_arrays(
                    [*whole, *map(pa.array, sums), pa.array(add(logs[found])), pa.array(add(logs[found] * other - spread)), pa.array(np.add.reduceat(each, starts))], names=NAMES
                )
                if len(met):
                    texts_of, tokens_of = map(pa.array, np.divmod(met, len(kinds)))
                    none = [pa.nulls(len(met), pa.int64())] * 2 + [pa.nulls(len(met), pa.float64())] * 3
                    yield pa.RecordBatch.from_arrays([*(c.take(texts_of) for c in first), kinds.take(tokens_of), pa.array(times, pa.int64()), *none], names=NAMES)

    NAMES = ["id", "key", "held_out", "token", "n", "n_tokens", "n_known", "logs", "other_logs", "model"]
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), *T._parse_datatype_string("key long, held_out boolean, token binary, n long, n_tokens long, n_known long, logs double, other_logs double, model double").fields])
    scored = texts.select("id", "held_out", F.xxhash64("bytes").alias("key"), "bytes").mapInArrow(score, schema)
    met = scored.join(counts, "token", "left")
    rare = F.when(F.col("n_tokens").isNull(), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))
    sums = met.groupBy("id", "key", "held_out").agg(
        F.count("n_tokens").cast("int").alias("rows"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "other_logs", "model")],
        F.coalesce(F.sum(rare), F.lit(0.0)).alias("rare_logs"),
        F.coalesce(F.sum(F.when(F.col("n_tokens").isNull() & F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("rare_known"),
    )
    v = vocabulary.value
    end_log = float(np.log10(v.ends + 1.0))
    each = lambda c: F.col(c) / F.col("rows")
    count = lambda c: (F.col(c) / F.col("rows")).cast("long")
    spread = float(np.log10(v.total + v.distinct + 1))
    return sums.select(
        F.col("id").alias(id_col),
        "held_out",
        count("n_tokens").alias("n_tokens"),
        (count("n_known") + count("rare_known")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (each("logs") + each("rare_logs") + F.lit(end_log) - count("n_tokens") * F.lit(spread)).alias("base_score"),
        (each("model") + each("other_logs") + each("rare_logs")).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("again"),
    ).drop("again")
