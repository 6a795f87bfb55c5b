"""N-gram Jaccard join with signature trees.

1. Every text becomes the set of its word shingles (64-bit hashes).  Equal sets
   are one class; from here on a class is one row, so exact copies cost nothing.
2. Two sets that link must share a token of their first ``n - ceil(t n) + 1``
   in a global order, so a token's holders form a block; of prefixes a little
   longer they share several, and a set that shares fewer with all others is out.
   The order puts tokens found often in a sample last, which grows with the
   corpus; any order is exact, this one keeps blocks small.
3. First pass: blocks of the few least tokens by hash and of similar size, each
   member checked against the least one.  The links join most groups of copies
   at linear cost.
4. Blocks that hold more than one component get signature trees.  A node holds
   the OR of its members' token bitmaps, their size range and the slack of the
   bitmaps; a dual traversal drops node pairs that cannot reach the overlap they
   would need, and those that are in one component already.  Larger blocks are
   cut into chunks.  A second pass, over ``TREE_TOKENS`` tokens by hash, meets
   each chunk with itself and verifies the likeliest pairs of each document, which
   joins most that is left; blocks of several chunks are dealt again, so their
   chunks join too.  A third, over all prefix tokens, meets every pair of chunks in
   a task of its own, so no block is capped, and verifies every candidate whose
   components still differ.
5. Candidates are verified on the exact sets of the whole texts.

Edge cases: null and empty texts have an empty set and link with nothing;
texts with fewer words than a shingle are one shingle; rows with a null id are
returned and link with nothing (component null); rows that share an id are one
node: what links to one of them links to all.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import ship
from .common import byte_texts, fewer, forget, materialize, release, text_blocks, written
from .components import components

#: Documents of the sample that finds frequent tokens: so many, or one in SAMPLE_SHARE; and the count that makes one frequent.
SAMPLE_DOCS, SAMPLE_SHARE, SAMPLE_HITS = 8000, 64, 4
#: Most frequent tokens that are kept (8 bytes each).
MOST_FREQUENT = 1_000_000
FIRST_TOKENS = 4
#: Tokens of the second pass, and the pairs of each document that it verifies.
TREE_TOKENS, LIKELIEST = 8, 3
#: Times that it deals blocks larger than a chunk to chunks.
TURNS = 2
CHUNK = 1024
LEAF = 16
#: Percent of its size by which a prefix is longer than one common token would need.
SPARE = 5
CACHED_WORDS = 100_000
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Nodes from here on stand for rows whose id they share or lack.
SHARED = 1 << 62

_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; word hashes are remembered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: bytes) -> np.ndarray:
        known = self.known
        words = text.lower().split()
        try:
            joined = b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            digest = xxhash.xxh3_64_digest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            joined = b"".join([known[w] for w in words])
        return np.frombuffer(joined, "<u8")

    def set(self, text: bytes) -> np.ndarray:
        h = self.words(text)
        n = max(len(h) - self.width + 1, 1 if len(h) else 0)
        if not n:
            return h
        k = min(self.width, len(h))
        code = h[:n] + np.uint64(k)
        for j in range(1, k):
            code = code * _K + h[j : n + j]
        return np.unique(_mix(code))


_shinglers: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    if width not in _shinglers:
        _shinglers[width] = Shingler(width)
    return _shinglers[width]


def bitmap_bits(n: int) -> int:
    """Width of a set's bitmap: a power of two above 4 n, between 64 and 2^19.

    With few tokens on a bit, nearly every token that a set lacks shows.
    """
    return 1 << min(19, max(6, math.ceil(math.log2(4 * n + 1))))


def bitmap(tokens: np.ndarray) -> bytes:
    bits = bitmap_bits(len(tokens))
    flags = np.zeros(bits, np.uint8)
    flags[(tokens >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def fold(packed: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer 64-bit words: the OR of its parts."""
    return np.bitwise_or.reduce(packed.reshape(-1, words), axis=0)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set's prefix: two sets that link share 1 + SPARE % of the smaller one's size of them at least.

    Of the o common tokens, the k-th in order has o - k common ones after it, so
    it is among the first n - o + k of a set, and o is at least percent of n.
    """
    return min(n, n - -(-percent * n // 100) + 1 + n * SPARE // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


class SignatureTree:
    """Members of a block, ordered by size, halved down to leaves."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, maps: np.ndarray):
        self.sizes, self.labels, self.maps = sizes, labels, maps
        self.slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, a: int, b: int) -> tuple:
        """(OR bitmap, least size, largest size, slack, least label, largest label) of members a..b."""
        if (a, b) not in self.nodes:
            s, x = self.sizes[a:b], self.labels[a:b]
            self.nodes[a, b] = (np.bitwise_or.reduce(self.maps[a:b], axis=0), int(s.min()), int(s.max()), int(self.slack[a:b].max()), int(x.min()), int(x.max()))
        return self.nodes[a, b]


def node_pair_may_link(p: tuple, q: tuple, percent: int) -> bool:
    """Whether any member of node p may link with one of node q in another component."""
    if p[4] == p[5] == q[4] == q[5] or 100 * p[2] < percent * q[1] or 100 * q[2] < percent * p[1]:
        return False
    common = int(np.bitwise_count(p[0] & q[0]).sum())
    # x and y share at most |x| - |bits of x| + |common bits| tokens, and need this many:
    need = -(-percent * (p[1] + q[1]) // (100 + percent))
    return min(p[3], q[3]) + common >= need


def traverse(left: SignatureTree, right: SignatureTree | None, percent: int) -> list[tuple[int, int, int]]:
    """Candidate (i, j, largest possible overlap) of two trees, or of one with itself (right is None, i < j)."""
    other = right or left
    out: list[tuple[int, int, int]] = []
    stack = [((0, len(left.sizes)), (0, len(other.sizes)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        if not node_pair_may_link(left.node(a, b), other.node(c, d), percent):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            x, y = left.sizes[a:b, None], other.sizes[None, c:d]
            both = np.bitwise_count(left.maps[a:b, None, :] & other.maps[None, c:d, :]).sum(axis=2, dtype=np.int64)
            most = np.minimum(left.slack[a:b, None], other.slack[None, c:d]) + both
            hit = ((100 + percent) * most >= percent * (x + y)) & (left.labels[a:b, None] != other.labels[None, c:d])
            hit &= (100 * x >= percent * y) & (100 * y >= percent * x)
            out += [(a + i, c + j, int(most[i, j])) for i, j in np.argwhere(hit).tolist() if right is not None or a + i < c + j]
            continue
        halves = lambda s, e: [(s, e)] if e - s <= LEAF else [(s, (s + e) // 2), ((s + e) // 2, e)]
        stack += [(p, q) for p in halves(a, b) for q in halves(c, d) if right is not None or p[0] <= q[0]]
    return out


def block_candidates(members: list[tuple], percent: int, i: int, j: int) -> list[tuple[int, int, float]]:
    """Candidate (id, id, estimate) of a block's rows (id, label, size, bitmap, chunk).

    Bitmaps of one width make a tree; sets that may link differ in width by one
    step at most, as a width is a power of two and sizes differ by less than two.
    """
    by_width: dict[int, list[tuple]] = {}
    for m in sorted(members, key=lambda m: (m[2], m[0])):
        by_width.setdefault(len(m[3]) // 8, []).append(m)

    def tree(rows: list[tuple], words: int) -> SignatureTree:
        maps = np.array([fold(np.frombuffer(m[3], "<u8"), words) for m in rows])
        return SignatureTree(np.array([m[2] for m in rows]), np.array([m[1] for m in rows]), maps)

    out = []
    for words, rows in by_width.items():
        for width in (words, 2 * words):
            other = by_width.get(width, [])
            for p, q in {(i, j), (j, i)} if width != words else {(i, j)}:
                x, y = [m for m in rows if m[4] == p], [m for m in other if m[4] == q]
                alone = width == words and i == j
                if (len(x) > 1) if alone else (x and y):
                    hits = traverse(tree(x, words), None if alone else tree(y, words), percent)
                    y = x if alone else y
                    out += [(x[a][0], y[b][0], most / max(x[a][2], y[b][2])) for a, b, most in hits]
    return out


def signatures(docs: DataFrame, width: int, percent: int, frequent: np.ndarray | None) -> DataFrame:
    """docs (id, text) -> (id, n, set_key binary, heads array<long>, prefix array<long>, bitmap binary).

    ``heads`` are the least tokens by hash alone, a random sample of the set.
    """

    def run(batches):
        shing = shingler(width)
        for batch in batches:
            for block in text_blocks(batch):
                rows = []
                for text in byte_texts(block.column(1)):
                    tokens = shing.set(text)
                    n = len(tokens)
                    if not n:
                        rows.append((0, None, [], [], None))
                        continue
                    ordered = tokens
                    if frequent is not None and len(frequent):
                        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                        often = frequent[at] == tokens
                        ordered = np.concatenate([tokens[~often], tokens[often]])
                    first = ordered[: prefix_length(n, percent)].view(np.int64)
                    rows.append((n, xxhash.xxh3_128_digest(tokens.tobytes()), tokens[:TREE_TOKENS].view(np.int64), first, bitmap(tokens)))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)]], names=["id", "n", "set_key", "heads", "prefix", "bitmap"])
        shing.known.clear()

    return docs.mapInArrow(run, "id long, n long, set_key binary, heads array<long>, prefix array<long>, bitmap binary")


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Tokens that are frequent in the sample: a sorted array of ``MOST_FREQUENT`` at most.

    With one document in 64, a token in a few hundred documents is known as
    frequent at any size of the corpus, so blocks of rare ones stay small.
    """
    total = docs.count()
    step = max(1, total // max(SAMPLE_DOCS, total // SAMPLE_SHARE))

    def run(batches):
        shing = shingler(width)
        for batch in batches:
            for block in text_blocks(batch):
                sets = [shing.set(t) for t in byte_texts(block.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64), type=pa.int64())], names=["token"])
        shing.known.clear()

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(step)) == 0)
    counts = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= SAMPLE_HITS)
    top = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(top.view(np.uint64))


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose exact sets link; texts are joined on, a block at a time."""
    needed = materialize(fewer(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()), "needed")
    # Few ids are sent to the texts; beyond the bound, texts and ids are shuffled.
    wanted = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = materialize(docs.join(wanted, "id", "left_semi"), "texts")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        shing, cache = shingler(width), OrderedDict()

        def tokens(text: bytes) -> np.ndarray:
            if text in cache:
                cache.move_to_end(text)
            else:
                cache[text] = shing.set(text)
                if len(cache) > 128:
                    cache.popitem(last=False)
            return cache[text]

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in (0, 1)], byte_texts(batch.column(2)), byte_texts(batch.column(3)))
            good = [(a, b) for a, b, s, t in rows if linked(tokens(s), tokens(t), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], type=pa.int64()) for k in (0, 1)], names=["u", "v"])
            del rows
            release()
        shing.known.clear()

    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long")


def may_link(n_a: int, n_b: int, map_a: bytes, map_b: bytes, percent: int) -> bool:
    """Whether two sets can link by their sizes and bitmaps alone."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    words = min(len(map_a), len(map_b)) // 8
    a, b = fold(np.frombuffer(map_a, "<u8"), words), fold(np.frombuffer(map_b, "<u8"), words)
    common = int(np.bitwise_count(a & b).sum())
    most = common + min(n_a - int(np.bitwise_count(a).sum()), n_b - int(np.bitwise_count(b).sum()))
    return (100 + percent) * most >= percent * (n_a + n_b)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out."""
    side = lambda k: reps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"map_{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "map_a", "map_b")

    def run(batches):
        for batch in batches:
            keep = [may_link(*row, percent) for row in zip(*[batch.column(k).to_pylist() for k in range(2, 6)])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))
            release()

    return rows.mapInArrow(run, "a long, b long")


def first_pass(reps: DataFrame) -> DataFrame:
    """(a, b): of the blocks of a token and a size band, each member with the least one."""
    band = F.floor(F.log("n") / F.log(F.lit(1.3))).alias("band")
    rows = reps.select("id", band, F.explode(F.slice("heads", 1, FIRST_TOKENS)).alias("token"))
    least = rows.groupBy("token", "band").agg(F.min("id").alias("a"), F.max("id").alias("most"))
    least = materialize(fewer(least.where(F.col("a") != F.col("most")).select("token", "band", "a")), "least")
    return rows.join(least, ["token", "band"]).where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()


def mixed_blocks(reps: DataFrame, of: str, chunk: int = CHUNK) -> DataFrame:
    """(token, chunks): the blocks that hold several components, and the chunks they are cut into."""
    rows = reps.select("label", F.explode(of).alias("token"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held"))
    return materialize(fewer(mixed.where(F.col("low") != F.col("high")).select("token", F.ceil(F.col("held") / chunk).alias("chunks"))), "mixed")


def block_pairs(reps: DataFrame, percent: int, mixed: DataFrame, of: str = "prefix", turn: int = 0) -> DataFrame:
    """(a, b, estimate): candidates of the blocks that hold several components.

    ``of``: the tokens that make blocks.  Over "prefix" every pair of a block's
    chunks is traversed and no link is missed.  Over "heads" each chunk meets
    itself alone, dealt anew each ``turn``, and of each member only the likeliest
    pairs come out, so the cost is linear in the size of a group.
    """
    rows = reps.select("id", "label", F.posexplode(of).alias("place", "token"))
    members = rows.select("id", "place", "token").join(mixed, "token")
    sets = reps.select("id", "label", "n", "bitmap")
    if of == "prefix":
        # Sets that link share so many tokens of their prefixes that most of those with a common passage drop out.
        members = materialize(members, "members")
        most = F.ceil(F.col("n") * percent / 100)
        shared = members.groupBy("id").agg(F.count("*").alias("shared"))
        sets = sets.join(shared, "id").where(F.col("shared") >= 1 + F.floor(most * SPARE / 100))
        members = members.join(sets, "id").where(F.col("place") < F.col("n") - most + 1)
    else:
        members = members.join(sets, "id")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5 + turn)), F.col("chunks")))
    everyone = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    members = members.withColumn("other", F.explode(everyone) if of == "prefix" else F.col("chunk"))
    best = None if of == "prefix" else LIKELIEST
    members = members.select("token", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "label", "n", "bitmap", "chunk")
    dealt = members.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        key, held = None, []
        for batch in batches:
            found = []
            for row in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if row[:3] != key:
                    if len(held) > 1:
                        found += most_likely(block_candidates(held, percent, key[1], key[2]), best)
                    key, held = row[:3], []
                held.append(row[3:])
            yield _pairs(found)
            release()
        if len(held) > 1:
            yield _pairs(most_likely(block_candidates(held, percent, key[1], key[2]), best))
        held = []
        release()

    return dealt.mapInArrow(run, "a long, b long, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def _pairs(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    best = {(min(a, b), max(a, b)): e for a, b, e in found}
    columns = [pa.array([p[k] for p in best], type=pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(best.values()), type=pa.float64())], names=["a", "b", "estimate"])


def most_likely(found: list[tuple[int, int, float]], best: int | None) -> list[tuple[int, int, float]]:
    """Of each id its ``best`` pairs, in the order of :func:`likeliest`, to which the others of a block can't belong; None: all."""
    if best is None:
        return found
    taken: Counter = Counter()
    out = []
    for a, b, estimate in sorted(((min(a, b), max(a, b), e) for a, b, e in found), key=lambda p: (-p[2], p[0], p[1])):
        if taken[a] < best or taken[b] < best:
            out.append((a, b, estimate))
        taken[a] += 1
        taken[b] += 1
    return out


def likeliest(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b): for each document its pairs of the highest estimates; the rest waits for the pass over all."""
    both = pairs.select(F.col("a").alias("own"), "a", "b", "estimate").union(pairs.select(F.col("b").alias("own"), "a", "b", "estimate"))
    w = Window.partitionBy("own").orderBy(F.desc("estimate"), "a", "b")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("a", "b").distinct()


def relabel(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` with label: the component that the links make of each class so far."""
    so_far = components(links)
    return reps.join(so_far, reps.id == so_far.node, "left").select(*reps.columns, F.coalesce("component", "id").alias("label"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(id, n_shingles, component_id): one row per document, linked where ``100 |x & y| >= percent |x | y|``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.where(F.col("id").isNotNull())
    frequent = frequent_tokens(keyed, width)
    sigs = materialize(signatures(texts, width, percent, frequent), "signatures")
    usable = sigs.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # One row for each class, that of its least id.
    least = F.min(F.struct("id", "n", "heads", "prefix", "bitmap")).alias("r")
    reps = materialize(usable.groupBy("set_key").agg(least).select("set_key", "r.*"), "classes")
    classes = reps.select("set_key", F.col("id").alias("rep"))
    # Rows that share an id tie the classes they belong to.
    shared = usable.groupBy("id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("id")
    ties = usable.join(shared, "id", "left_semi").join(classes, "set_key").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    # What led to the links, the texts of their pairs above all, is deleted once they are written.
    since = len(written())
    links = materialize(verify(materialize(plausible(first_pass(reps), reps, percent), "pairs"), keyed, width, percent).unionByName(ties), "links")
    forget(docs.sparkSession, since)
    labelled = relabel(reps, links)
    for turn in range(TURNS):
        since = len(written())
        mixed = mixed_blocks(labelled, "heads", chunk)
        whole = mixed.where("chunks > 1").isEmpty()
        near = likeliest(materialize(block_pairs(labelled, percent, mixed, "heads", turn), "near"), LIKELIEST)
        more = verify(materialize(fewer(near), "pairs"), keyed, width, percent)
        links = materialize(links.union(more), "links")
        forget(docs.sparkSession, since)
        labelled = relabel(reps, links)
        if whole:  # every block was met whole
            break
    mixed = mixed_blocks(labelled, "prefix", chunk)
    rest = verify(materialize(block_pairs(labelled, percent, mixed).select("a", "b"), "pairs"), keyed, width, percent)
    final = components(links.union(rest))

    ends = classes.join(final, classes.rep == final.node, "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    ends = materialize(fewer(ends), "ends")
    out = sigs.select("id", "n", "set_key").join(ends, "set_key", "left")
    # Empty sets, and rows without an id, stay alone; a tied id may still have a component.
    alone = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return alone


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the least id.

    What is linked are distinct (id, text): rows that share an id but no link all
    stay, and rows without an id are compared like any others (they stay where no
    row with an id is linked; the one of the least hash, of several).  Of rows equal
    in id and text the one with the least other columns stays.
    """
    again = docs.groupBy(F.col(id_col).alias("again_id")).count().where("count > 1 or again_id is null").select("again_id")
    again = materialize(again, "again")
    if again.isEmpty():
        linked = jaccard_components(docs, id_col, text_col, **options)
        extra = materialize(linked.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("extra_id")), "extra")
        return docs.join(extra, docs[id_col] == extra.extra_id, "left_anti")
    # A row whose id does not name it alone is a node of its own: a hash of id and text, above all ids.
    key = F.lit(SHARED) + F.pmod(F.xxhash64(F.col("row").getField(id_col), F.col("row").getField(text_col)), F.lit(SHARED))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own"))
    rows = rows.join(again, rows.own.eqNullSafe(again.again_id), "left_semi").withColumn("node", key).unionByName(rows.join(again, rows.own.eqNullSafe(again.again_id), "left_anti").withColumn("node", F.col("own")))
    linked = jaccard_components(rows.select("node", F.col("row").getField(text_col).alias("text")), "node", "text", **options)
    linked = materialize(linked.select("node", F.col("component_id").alias("component")).distinct(), "linked")
    shared = materialize(rows.where(F.col("node") >= SHARED).select("node", "own").distinct(), "shared")
    # A component's number is its least id that names one row; a shared id may be less.
    best = linked.join(shared, "node").groupBy("component").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "node")).alias("b"))
    takes = (F.col("b.own") < F.col("component")) | (F.col("component") >= SHARED)
    stays = linked.join(best, "component", "left").select("node", F.when(takes, F.col("b.node")).otherwise(F.col("component")).alias("stays"))
    extra = materialize(stays.where("node <> stays").select(F.col("node").alias("extra")), "extra")
    kept = rows.join(extra, rows.node == extra.extra, "left_anti")
    order = [text_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    once = kept.where(F.col("node") >= SHARED).groupBy("node").agg(F.min(F.struct(F.col("own"), *[F.col("row").getField(c).alias(f"c{n}") for n, c in enumerate(order)])).alias("r"))
    once = once.select(F.col("r.own").cast(docs.schema[id_col].dataType).alias(id_col), *[F.col("r").getField(f"c{n}").alias(c) for n, c in enumerate(order)])
    return kept.where(F.col("node") < SHARED).select("row.*").unionByName(once)
