"""Document fingerprints: one-permutation MinHash (native).

1. The word shingles of a text (five words; with fewer words, the whole sequence)
   are hashed once each: 60 bits of MD5, so SQL can follow them.
2. The high bits of a hash name one of ``bins`` bins, of which the least hash is
   kept.  The hashes are sorted, so a bin's least is the first of its run: no
   shuffle, one pass over the text.
3. An empty bin takes the value of the first filled bin in its own probing order,
   a permutation drawn once for each bin by hash and the same for all texts, so
   bins are borrowed evenly and alike (optimal densification).
4. A bin's value is hashed with the bin's own two numbers and its low ``bits`` bits
   are packed, as hexadecimal digits: 256 bins of 8 bits are 512 digits.
5. Two fingerprints agree in a bin if the value is the same, or by chance in one
   of 2^bits cases: ``likeness`` takes the chance out, (m - c) / (1 - c).

Everything is one Column expression; lambdas bind what is used more than once.

Edge cases: null texts are taken as empty; an empty text (or one without words)
has the empty fingerprint, which is like itself (1) and like nothing else (0);
equal texts have equal fingerprints; A-Z are lower-cased, nothing else is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import ship
from .common import WORD, bound, fewer, materialize

WIDTH, BINS, BITS = 5, 256, 8
#: Hexadecimal digits of a shingle's MD5 that are its hash.
DIGITS = 15
#: Values are taken modulo this prime before the low bits are.
PRIME = (1 << 31) - 1
#: Probes of an empty bin that are tried in turn, before the filled bins are ranked.
PROBES = 16


def bin_numbers(bins: int) -> dict[str, list[int]]:
    """For each bin its probing order, (start + t * step) mod bins for t = 0, 1, ..., and the factor and shift of its value."""
    digests = [hashlib.md5(f"bin:{i}".encode()).hexdigest() for i in range(bins)]
    part = lambda k: [int(d[8 * k : 8 * k + 8], 16) for d in digests]
    steps = [x % (bins // 2) * 2 + 1 for x in part(1)]
    return {"start": [x % bins for x in part(0)], "step": steps, "back": [pow(x, -1, bins) for x in steps], "factor": [x % (PRIME - 1) + 1 for x in part(2)], "shift": [x % PRIME for x in part(3)]}


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """array<long>: the hashes of a text's word shingles, in their order."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Past the end of a short text there is nothing, which concat_ws leaves out.
    words = lambda w, i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)])
    one = lambda w, i: F.conv(F.substring(F.md5(words(w, i)), 1, DIGITS), 16, 10).cast("long")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
    hashes = lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: one(w, i))).otherwise(F.array().cast("array<bigint>"))
    return bound(F.regexp_extract_all(lower, F.lit(WORD), 0), hashes)


def bin_of(h: Column, bins: int) -> Column:
    return F.shiftright(h, _within(bins)).cast("int")


def _within(bins: int) -> int:
    """Bits of a hash below those that name its bin."""
    return 4 * DIGITS - (bins.bit_length() - 1)


def minima(hashes: Column, bins: int) -> Column:
    """array<long> of ``bins``: the least hash of each bin, null where there is none.

    Each bin's highest possible value is sorted in with the hashes; a bin that has it for its least is empty.
    """
    last = lambda i: F.shiftleft(i.cast("long") + 1, _within(bins)) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), last)
    first = lambda h: F.filter(h, lambda x, i: (i == 0) | (bin_of(x, bins) != bin_of(F.get(h, i - 1), bins)))
    return F.transform(bound(F.sort_array(F.concat(hashes, marks)), first), lambda x, i: F.when(x != last(i), x))


def densified(least: Column, bins: int) -> Column:
    """array<long>: ``least`` with each empty bin's value taken from the first filled bin in its probing order."""
    numbers = {k: F.array(*[F.lit(x) for x in v]) for k, v in bin_numbers(bins).items() if k in ("start", "step", "back")}

    def fill(v: Column, filled: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start, step, back = (F.get(numbers[k], i) for k in ("start", "step", "back"))
            probes = [F.get(v, (start + t * step) % bins) for t in range(PROBES)]
            # The same order for what is left: a filled bin's place in the permutation.
            rank = lambda y: F.struct(F.pmod((bin_of(y, bins) - start) * back, F.lit(bins)).alias("rank"), y.alias("value"))
            return F.coalesce(x, *probes, F.array_min(F.transform(filled, rank))["value"])

        return F.transform(v, one)

    return bound(least, lambda v: bound(F.filter(v, lambda x: x.isNotNull()), lambda filled: fill(v, filled)))


def packed(values: Column, bins: int, bits: int) -> Column:
    """The low bits of each bin's value under the bin's own hash, as hexadecimal digits."""
    numbers = bin_numbers(bins)
    factor, shift = (F.array(*[F.lit(x).cast("long") for x in numbers[k]]) for k in ("factor", "shift"))
    low = lambda x, i: ((x % PRIME * F.get(factor, i) + F.get(shift, i)) % PRIME).bitwiseAND((1 << bits) - 1)
    if bits % 4 == 0:  # a one in front keeps the zeros
        return F.lower(F.array_join(F.transform(values, lambda x, i: F.substring(F.hex(low(x, i) + (1 << bits)), 2, bits // 4)), ""))
    together = 4 // bits
    digit = lambda k: sum((low(F.get(values, k * together + j), k * together + j) * (1 << (bits * j)) for j in range(together)), F.lit(0).cast("long"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins // together - 1)), lambda k: F.lower(F.hex(digit(k)))), "")


def fingerprint(text: Column, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> Column:
    """A text's fingerprint; ``bins`` is a power of two (16 to 65,536), ``bits`` one of 1, 2, 4, 8, 12, 16."""
    if bins & (bins - 1) or not 16 <= bins <= 65536 or bits not in (1, 2, 4, 8, 12, 16):
        raise ValueError(f"bins {bins} or bits {bits} are not supported")
    whole = lambda h: F.when(F.size(h) > 0, packed(densified(minima(h, bins), bins), bins, bits)).otherwise("")
    return bound(shingle_hashes(F.coalesce(text, F.lit("")), width), whole)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two texts' shingle sets, from 0 to 1, the chance of equal low bits taken out."""
    if bits % 4 == 0:
        values = lambda x: F.regexp_extract_all(x, F.lit("." * (bits // 4)), 0)
        matches = F.size(F.filter(F.zip_with(values(a), values(b), lambda x, y: x == y), lambda x: x))
    else:
        together = 4 // bits
        digit = lambda s, k: F.conv(F.substring(s, k + 1, F.lit(1)), 16, 10).cast("int")
        field = lambda x, j: F.shiftright(x, j * bits).bitwiseAND((1 << bits) - 1)
        count = lambda x, y: sum(((field(x, j) == field(y, j)).cast("int") for j in range(together)), F.lit(0))
        matches = F.aggregate(F.sequence(F.lit(0), F.lit(bins // together - 1)), F.lit(0), lambda n, k: n + count(digit(a, k), digit(b, k)))
    chance = 1.0 / (1 << bits)
    guess = F.greatest(F.lit(0.0), (matches / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(guess)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key names what is equal in id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_chars, next_key): the document that follows each in descending order of id; the last is followed by the first.

    Only ids, keys and lengths are sorted, by ranges of the id (of the key, where
    ids are equal), so no id fills a partition.  Each range is numbered on its own
    and its last document gets the first one of the next range: one row a range.
    Rows equal in id and text are one document; null ids come last.
    """
    rows = _keyed(docs, id_col, text_col).select("id", "key", F.length("text").cast("long").alias("n_chars")).dropDuplicates(["id", "key"])
    # Written, as a range partitioning that is computed again may cut elsewhere.
    rows = materialize(fewer(rows.repartitionByRange("id", "key").withColumn("part", F.spark_partition_id())), "ranges")
    rows = rows.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), F.desc("key"))))
    tops = rows.groupBy("part").agg(F.max(F.struct("id", "key")).alias("top"))
    down = Window.orderBy(F.desc("part"))
    after = F.coalesce(F.lead("top").over(down), F.first("top").over(down))["key"]
    out = rows.join(F.broadcast(tops.select("part", after.alias("after"))), "part")
    return out.select("id", "key", "n_chars", F.coalesce("next_key", "after").alias("next_key"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3, **options) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of ``docs``.

    The edited text has the last ``floor(n_chars / share)`` code points replaced by
    the first as many of the next document.  Texts are shuffled once by their
    key, and the heads that are taken from them once more.
    """
    ship(docs.sparkSession)
    order = materialize(fewer(successors(docs, id_col, text_col)), "successors")
    rows = _keyed(docs, id_col, text_col).select("key", "text").withColumn("fingerprint", fingerprint(F.col("text"), **options))
    before = order.select(F.col("next_key").alias("key"), F.col("id").alias("to_id"), F.col("key").alias("to_key"), F.expr(f"int(n_chars div {share})").alias("wanted"))
    heads = rows.join(before.hint("shuffle_hash"), "key").groupBy("to_key").agg(F.first("to_id").alias("id"), F.first(F.expr("left(text, wanted)")).alias("head"), F.first("fingerprint").alias("next_fingerprint"))
    own = rows.join(heads.hint("shuffle_hash"), rows.key == heads.to_key)
    edited = F.concat(F.expr(f"left(text, int(length(text) - length(text) div {share}))"), F.col("head"))
    made = own.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = made.withColumn("edited_fingerprint", fingerprint(F.col("edited"), **options))
    like = lambda other: likeness(F.col("fingerprint"), F.col(other), **{k: v for k, v in options.items() if k != "width"})
    return made.select("id", "n_chars", "edited", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
