"""Document fingerprints by order MinHash, in column expressions only.

A k-mer is ``k`` consecutive words (a text with fewer has one, of all its words). Each k-mer carries its
occurrence number, so repeats count. A hash of (k-mer, number) deals them to ``2**BIN_BITS`` bins and orders
them there; of each bin the ``take`` smallest are kept, put back in text order, and the tuple of their
k-mers is hashed. Every bin thus is one hash function of the sketch, over its own part of the k-mers, and
one hash of each k-mer serves all of them. Moved or swapped words change the tuples, as they change the
edit distance. A text without words has an empty signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.llm.common import order_slices, space_words

BIN_BITS = 6
K, TAKE = 2, 2
#: Steps of the search for the start of a run of equal k-mers; arrays have fewer than 2**31 entries.
STEPS = [1 << b for b in range(30, -1, -1)]


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def with_signature(df: DataFrame, text_col: str, name: str, k: int = K, take: int = TAKE) -> DataFrame:
    """Adds ``name``: array<int>, one entry for each bin in use: bin number, then 32 - BIN_BITS bits of the tuple's hash.

    Null texts count as empty. The columns of ``df`` must not start with ``_om_``.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*keep, space_words(F.col(text_col)).alias("_om_words"))
    words = F.col("_om_words")
    whole = F.array(F.xxhash64(words))
    several = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    kmers = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < k, whole).otherwise(several)
    step = step.select(*keep, kmers.alias("_om_h"))
    h = F.col("_om_h")

    # Hash above, place below: after sorting, equal k-mers stand together in text order.
    bits = F.length(F.bin(F.size(h)))
    step = step.select(*keep, h, bits.alias("_om_bits"), (_left(F.lit(1).cast("long"), bits) - 1).alias("_om_mask"))
    bits, mask = F.col("_om_bits"), F.col("_om_mask")
    placed = F.sort_array(F.transform(h, lambda x, i: _left(x, bits).bitwiseOR(i.cast("long"))))
    step = step.select(*keep, h, bits, mask, placed.alias("_om_p"))
    p = F.col("_om_p")

    def number(x: Column, i: Column) -> Column:
        """Which occurrence of its k-mer the entry is, from 1."""
        same = lambda back: (i >= back) & (_right(F.get(p, i - back), bits) == _right(x, bits))
        far = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda off, b: F.when((i - off >= b) & (_right(F.get(p, i - off - b), bits) == _right(x, bits)), off + b).otherwise(off))
        return F.when(~same(1), 1).when(~same(2), 2).when(~same(3), 3).otherwise(far + 1)

    def ordered(x: Column, i: Column) -> Column:
        place = x.bitwiseAND(mask)
        return F.xxhash64(F.get(h, place.cast("int")), number(x, i)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(place)

    step = step.select(*keep, h, mask, F.sort_array(F.transform(p, ordered)).alias("_om_o"))
    o = F.col("_om_o")
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    least = F.filter(o, lambda x, i: (i < take) | (bin_of(F.get(o, i - take)) != bin_of(x)))
    step = step.select(*keep, h, mask, least.alias("_om_s"))
    s = F.col("_om_s")

    def entry(x: Column, i: Column) -> Column:
        places = F.array_sort(F.transform(F.filter(F.slice(s, i + 1, take), lambda y: bin_of(y) == bin_of(x)), lambda y: y.bitwiseAND(mask)))
        tuple_hash = F.xxhash64(F.transform(places, lambda q: F.get(h, q.cast("int"))))
        first = (i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(x))
        packed = F.shiftleft(bin_of(x), 32 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(tuple_hash, 32 + BIN_BITS))
        return F.when(first, packed.cast("int"))

    return step.select(*keep, F.array_compact(F.transform(s, entry)).alias(name))


def fingerprint(signature: Column) -> Column:
    """The signature as text, eight hexadecimal digits for each bin in use."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal bins over bins that either text uses, 0 to 1; two texts without words are alike."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, 32 - BIN_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def order_minhash(docs: DataFrame, text_col: str = "text", k: int = K, take: int = TAKE) -> DataFrame:
    """``docs`` with ``signature`` (array<int>) and ``fingerprint`` (string) of each text; columns of these names are replaced."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("signature", "fingerprint")])
    signed = with_signature(kept, text_col, "signature", k, take)
    return signed.withColumn("fingerprint", fingerprint(F.col("signature")))


def following(keys: DataFrame) -> DataFrame:
    """Distinct key rows with ``following``, the struct of the next row's keys; the last has the first's.

    Slices of the global order are linked by one row each; no task holds more than a slice.
    """
    names = keys.columns
    cut = order_slices(keys, *[F.col(c) for c in names])
    own = F.struct(*names)
    firsts = cut.groupBy("_slice").agg(F.min(own).alias("first"))
    after = F.coalesce(F.lead("first").over(Window.orderBy("_slice")), F.min("first").over(Window.partitionBy(F.lit(0))))
    links = firsts.select("_slice", after.alias("after"))
    inside = cut.withColumn("next", F.lead(own).over(Window.partitionBy("_slice").orderBy(*names)))
    return inside.join(links, "_slice").select(*names, F.coalesce("next", "after").alias("following"))


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text and signature of each document and of the next by ascending id (after the last: the first).

    Equal ids follow each other by the digest of their texts; null ids come last, by digest too. Documents
    meet in buckets of 256 consecutive ids, which is the only shuffle of texts; the last of a bucket gets
    the first of the next bucket that has any.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = with_signature(texts, "text", "sig")
    digest = F.md5("text")
    late = F.col("id").isNull()
    bucket = F.coalesce(F.shiftright("id", 8), F.conv(F.substring(digest, 1, 4), 16, 10).cast("long"))
    # Text and signature travel as one column, so both readers below share one exchange.
    keyed = signed.select("id", digest.alias("digest"), F.struct("text", "sig").alias("own"), late.alias("late"), bucket.alias("bucket"))
    order = Window.partitionBy("late", "bucket").orderBy("id", "digest")
    linked = keyed.select(
        "*",
        F.lead("own").over(order).alias("after"),
        F.lag("digest").over(order).isNull().alias("is_first"),
    )
    firsts = linked.where("is_first").select(F.struct("late", "bucket").alias("following"), F.col("own").alias("opening"))
    buckets = texts.select(F.col("id").isNull().alias("late"), F.coalesce(F.shiftright("id", 8), F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("long")).alias("bucket")).distinct()
    openings = following(buckets).join(firsts, "following").select("late", "bucket", "opening")
    a, b = linked.alias("a"), openings.alias("b")
    same = (F.col("a.late") == F.col("b.late")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.after").isNull()
    nxt = F.coalesce("after", "opening")
    return a.join(b, same, "left").select("id", "own.text", "own.sig", nxt["text"].alias("next_text"), nxt["sig"].alias("next_sig"))


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the next document.

    The last floor(n_chars / 4) code points give way to the first as many (or all) of the next document.
    Null texts are empty; a single document is its own next. One row for each row of ``docs``.
    """
    pairs = with_next(docs, text_col, id_col)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = pairs.select("id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    signed = with_signature(both, "edited", "edited_sig")
    return signed.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
