"""Exact n-gram Jaccard join by partitioning the token universe (pigeonhole with one-deletion neighbourhoods).

A document's tokens are its distinct word shingles. Two sets of sizes s and l reach the similarity t only
if they differ in at most H = (s + l)(1 - t)/(1 + t) tokens. Sizes fall into bands; each band has a scheme
that hashes every token into one of m segments. A scheme gives every segment a level: -1 (not indexed),
0 (the segment's token subset must be equal) or 1 (it may differ by one token, found through the subsets
with one token deleted). When the levels plus one add up to H + 1 or more, two sets that differ in at most
H tokens agree in a segment within its level. Levels are allocated by cost: rows to index plus pairs met
by chance, counted on a bounded share of the sets; they steer work only, never the result.

A set needs less than its band when no linked set makes more differ with it than h < H tokens. It then leaves
out segments at level 0, those with the fewest tokens first (empty and small subsets are met by chance most),
as long as the levels plus one of all segments add up to h + 1 more than its left out ones. Segments in which
two linked sets agree add up to more than either leaves out, and equal subsets have the same place in that
order, so the first segment in which they agree is indexed for both.

Each distinct set is signed once, whatever the number of its documents. The signatures are matched a part of
the key space at a time (ROUNDS parts), so that the shuffles of a part are gone before the next begins; keys
of one set only end there. Each signature's sets form a bucket. Buckets are not expanded to pairs: each set is
first compared with its bucket's least one, through parity bitmaps (the bits in which two bitmaps differ never
exceed the tokens in which the sets differ), then verified exactly and united. Only in buckets whose sets are
still in several components are the other pairs across components looked at, in blocks of bounded size and
through the bitmaps: first the likeliest pairs that would join the components to trees, then all that are
left. What passes is verified exactly. So no link between different components is lost, and links inside one
need not be listed.

Tokens and sets are compared as 64-bit hashes (two of a pair's n tokens collide with a chance of n**2/2**65).

Defined results: null texts and texts without words have an empty set, which links with nothing; a text
with fewer words than a shingle is one shingle; rows with equal sets are linked; a row without doc_id takes
part, and takes the least id of its component if there is one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .graph import components
from .wordhash import GOLDEN, mix, set_hash, shingles

#: Segments beyond the needed ones, so that the costliest can be left out.
SPARE = 0.08
#: One in so many sets is counted to find the costs of segments; at most so many segments have costs.
COST_SHARE = 32
COST_SEGMENTS = 1 << 18
#: Sets of one bucket that a task compares at once.
BLOCK = 1024
#: Bits of a parity bitmap for each token that may differ, at least; pairs that differ in 1.2 times as many rarely pass.
BITS_PER_DIFFERENCE = 8
#: Sets (8 bytes each) whose names are broadcast.
FEW = 1_000_000
#: Parts of the key space that are matched one after another.
ROUNDS = 4


class Similarity:
    """Shingle length and least similarity, a fraction of whole numbers: denominator * common >= numerator * union.

    With its size bands [low, high), and each band's scheme: number of segments and the differences they cover.
    """

    def __init__(self, words: int, numerator: int, denominator: int = 100) -> None:
        self.words, self.numerator, self.denominator = words, numerator, denominator
        self.low: list[int] = []
        at = next(s for s in range(1, 10**6) if self.differing(2 * s + 1) >= 1)
        while at < 1 << 31:
            self.low.append(at)
            # Bands 2.25 times as wide as the sizes that link with one size.
            at = max(at + 1, -(-at * (4 * numerator + 9 * (denominator - numerator)) // (4 * numerator)))
        self.high = [*self.low[1:], at]
        #: The largest size that can link with a set of the band.
        self.reach = [(h - 1) * denominator // numerator for h in self.high]
        self.covered = [self.differing(h - 1 + r) for h, r in zip(self.high, self.reach, strict=True)]
        self.segments = [h + 1 + math.ceil(SPARE * (h + 1)) for h in self.covered]

    def of(self, size: int) -> list[int]:
        """The schemes that a set of this size is indexed in: its own band's and the next lower one's within reach."""
        b = int(np.searchsorted(self.low, size, "right")) - 1
        return [x for x in (b - 1, b) if x >= 0 and size <= self.reach[x]]

    def need(self, size: int, band: int) -> int:
        """The most tokens that differ between a set of this size and a linked one, of the pairs that the band's scheme must find."""
        other = size * self.denominator // self.numerator if size < self.high[band] else self.high[band] - 1
        return self.differing(size + other)

    def differing(self, sizes):
        """The most tokens in which two linked sets whose sizes add up to ``sizes`` can differ."""
        return sizes * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.denominator * common >= self.numerator * (len(a) + len(b) - common)

    def set_of(self, text: str | None) -> np.ndarray:
        return shingles((text or "").encode().lower(), self.words)

    def word_sets(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch["text"].to_pylist():
            yield self.set_of(text)


#: 3-word shingles, 0.9: what the queries and functions take unless told otherwise.
BANDS = Similarity(3, 90)
linked = BANDS.linked


def segment_keys(
    tokens: np.ndarray, band: int, levels: np.ndarray | None, like: Similarity = BANDS, need: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key) of a set under a band's scheme; levels None: all segments at level 0.

    With ``need``, without the keys at level 0 that a set which needs no more differences than that can spare.
    """
    m = like.segments[band]
    spread = mix(tokens + np.uint64((band + 1) * int(GOLDEN) % (1 << 64)))
    place = (spread >> np.uint64(33)).astype(np.int64) % m
    order = np.argsort(place, kind="stable")
    value, place = mix(spread[order]), place[order]
    starts = np.searchsorted(place, np.arange(m + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    sums = total[starts[1:]] - total[starts[:-1]]
    counts = np.diff(starts).astype(np.uint64)
    tag = mix((np.uint64(band) << np.uint64(32)) + np.arange(m, dtype=np.uint64))
    whole = mix(mix(sums + tag) + counts)
    if levels is None:
        return np.arange(m), whole
    taken = levels >= 0
    if need is not None:
        spare = int((levels + 1).sum()) - need - 1
        plain = np.flatnonzero(levels == 0)
        taken[plain[np.argsort(counts[plain], kind="stable")[: max(spare, 0)]]] = False
    segments, keys = np.flatnonzero(taken), whole[taken]
    one = np.flatnonzero(levels[place] == 1)
    if len(one):  # subsets with one token deleted share the keys of whole subsets of that size
        s = place[one]
        less = mix(mix(sums[s] - value[one] + tag[s]) + counts[s] - np.uint64(1))
        segments, keys = np.concatenate([segments, s]), np.concatenate([keys, less])
    return segments, keys


def documents_as_sets(docs: DataFrame, like: Similarity) -> DataFrame:
    """(doc_id, t, n, k): a hash of the text, set size and the hash that names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(like.word_sets(batch))
            n, k = [len(s) for s in sets], [set_hash(s) for s in sets]
            cols = [batch["doc_id"], batch["t"], pa.array(n, pa.int64()), pa.array(k, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "n", "k"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, n long, k long")


def allocate(texts: DataFrame, like: Similarity) -> dict[int, np.ndarray]:
    """Levels of the segments by band: the cheapest that add up to the band's need, and 0 for all others, so that sets
    can choose.

    Costs come from one set in COST_SHARE. A segment at level 0 costs one row a set and the pairs that
    meet in it by chance; at level 1, a row more for each token and the pairs of subsets one token smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, s, g = [], [], []
            for tokens in like.word_sets(batch):
                for band in like.of(len(tokens)):
                    segments, keys = segment_keys(tokens, band, None, like)
                    b.append(np.full(len(keys), band)), s.append(segments), g.append(keys.view(np.int64))
            cols = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (b, s, g)]
            yield pa.RecordBatch.from_arrays(cols, ["band", "segment", "sig"])

    some = texts.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(COST_SHARE)) == 0)
    met = some.select("text").mapInArrow(run, "band long, segment long, sig long").groupBy("band", "segment", "sig").agg(F.count(F.lit(1)).alias("c"))
    costs = (
        met.groupBy("band", "segment")
        .agg(F.sum("c").alias("rows"), F.sum(F.expr("c * (c - 1)")).alias("pairs"))
        .orderBy("band", "segment")
        .limit(COST_SEGMENTS)
        .collect()
    )
    by_band: dict[int, list] = {}
    for r in costs:
        by_band.setdefault(r.band, []).append(r)
    levels = {}
    for band, need in enumerate(like.covered):
        m = like.segments[band]
        if m > COST_SEGMENTS:
            break
        rows, pairs = np.ones(m), np.zeros(m)
        for r in by_band.get(band, ()):
            rows[r.segment], pairs[r.segment] = r.rows, r["pairs"]
        tokens = (like.low[band] + like.high[band]) / 2 / m
        first = rows + pairs * COST_SHARE
        second = rows * tokens + (tokens + 1) ** 2 * pairs * COST_SHARE
        chosen = np.argsort(np.concatenate([first, np.maximum(second, first)]), kind="stable")[: need + 1]
        levels[band] = np.maximum(np.bincount(chosen % m, minlength=m) - 1, 0)
    return levels


def texts_of(docs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, text): one text of each set that is not empty."""
    row = F.xxhash64("doc_id", "t").alias("r")
    rows = sets.filter("n > 0").groupBy("k", row).agg(F.count(F.lit(1)).alias("c"))
    one = scratch.save(rows.groupBy("k").agg(F.min("r").alias("r"), F.min_by("c", "r").alias("c")), "one-of-each")
    named = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("r"), "text")
    found = named.join(one.filter("c = 1").select("r", "k"), "r").select("k", "text")
    many = one.filter("c > 1").select("r", "k")
    if many.take(1):  # rows that repeat id and text
        found = found.unionByName(named.join(many, "r").select("k", "text").dropDuplicates(["k"]))
    return scratch.save(found, "texts")


def signatures(texts: DataFrame, levels: dict[int, np.ndarray], like: Similarity) -> DataFrame:
    """(k, n, bits, part0, part1, ...): every set's size, parity bitmap, and index keys under its schemes, an array for
    each part of the key space."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_band = shared.value
        for batch in batches:
            n, bits = [], []
            ends, values = [[0] for _ in range(ROUNDS)], [[np.zeros(0, np.int64)] for _ in range(ROUNDS)]
            for tokens in like.word_sets(batch):
                n.append(len(tokens)), bits.append(parity(tokens, like))
                found = []
                for band in like.of(len(tokens)):
                    levels = by_band.get(band, np.zeros(like.segments[band], np.int64))
                    found.append(segment_keys(tokens, band, levels, like, like.need(len(tokens), band))[1])
                keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                part = (keys % np.uint64(ROUNDS)).astype(np.int64)
                for i in range(ROUNDS):
                    values[i].append(keys[part == i].view(np.int64))
                    ends[i].append(ends[i][-1] + len(values[i][-1]))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate(v), pa.int64())) for e, v in zip(ends, values, strict=True)]
            cols = [batch["k"], pa.array(n, pa.int64()), pa.array(bits, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(cols, ["k", "n", "bits", *(f"part{i}" for i in range(ROUNDS))])

    parts = ", ".join(f"part{i} array<long>" for i in range(ROUNDS))
    return texts.select("k", "text").mapInArrow(run, f"k long, n long, bits binary, {parts}")


def buckets_of(index: DataFrame, part: int) -> DataFrame:
    """(sig, k, least, many): the signatures of two or more sets in a part of the key space, least set and size of the bucket."""
    rows = index.select("k", F.explode(f"part{part}").alias("sig"))
    least = rows.groupBy("sig").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    return rows.join(least, "sig").select("sig", "k", "least", "many")


def maybe_linked(pairs: DataFrame, index: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
            most = like.differing(na + nb)
            ok = np.abs(na - nb) <= most
            for at in np.flatnonzero(ok).tolist():
                x, y = batch["xa"][at].as_py(), batch["xb"][at].as_py()
                words = min(len(x), len(y)) // 8
                ok[at] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64) <= most[at]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda v: index.select(F.col("k").alias(v), F.col("n").alias(f"n{v}"), F.col("bits").alias(f"x{v}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def among(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The texts of the wanted sets, of which there are at most 2n; up to FEW they are broadcast, which spares shuffling the others."""
    wanted = wanted.distinct()
    return texts.join(F.broadcast(wanted) if 2 * n <= FEW else wanted, "k", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets are linked, checked on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if a != last:
                    last, kept = a, like.set_of(x)
                ok.append(like.linked(kept, like.set_of(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = among(texts, pairs.select(F.explode(F.array("a", "b")).alias("k")), pairs.count())
    both = pairs.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def parity(tokens: np.ndarray, like: Similarity) -> bytes:
    """Parity bitmap of a set; a smaller one is a larger one folded."""
    width = 1 << max(6, (BITS_PER_DIFFERENCE * (like.differing(2 * len(tokens)) + 1) - 1).bit_length())
    place = (mix(tokens + GOLDEN) >> np.uint64(16)).astype(np.int64) & (width - 1)
    odd = (np.bincount(place, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(raw: bytes, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, words), axis=0)


def cross_pairs(buckets: DataFrame, spanning: bool, like: Similarity) -> DataFrame:
    """Pairs (a, b) of a bucket across components that the bitmaps do not rule out.

    ``buckets``: sig, k, component, n, bits, blocks. As in a block matrix, each pair of blocks is one group.
    ``spanning``: of a group only the pairs, the likeliest first, that would join its components to trees.
    """
    own = F.pmod(F.xxhash64("k", F.lit(3)), F.col("blocks")).cast("int")
    rows = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "component", "n", "bits")
    parts = shuffle_partitions(buckets.sparkSession)
    dealt = rows.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "own", "k")

    def tree(pairs: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for _, a, b, ca, cb in sorted(pairs):
            u, v = find(ca), find(cb)
            if u != v:
                parent[u] = v
                yield a, b

    def compare(group: list[dict]) -> Iterator[tuple[int, int]]:
        i, j = group[0]["i"], group[0]["j"]
        left = [r for r in group if r["own"] == i]
        right = left if i == j else [r for r in group if r["own"] == j]
        if not left or not right:
            return
        words = min(len(r["bits"]) for r in group) // 8
        x, y = (np.stack([_folded(r["bits"], words) for r in side]) for side in (left, right))
        (kx, nx, cx), (ky, ny, cy) = (tuple(np.array([r[c] for r in side]) for c in ("k", "n", "component")) for side in (left, right))
        pairs = []
        for p in range(len(left)):
            most = like.differing(nx[p] + ny)
            ok = (cx[p] != cy) & (np.abs(nx[p] - ny) <= most)
            if i == j:
                ok[: p + 1] = False
            at = np.flatnonzero(ok)
            if len(at):
                apart = np.bitwise_count(y[at] ^ x[p]).sum(axis=1, dtype=np.int64)
                for q, slack in zip(at.tolist(), (apart - most[at]).tolist(), strict=True):
                    if slack <= 0:
                        pairs.append((slack, int(min(kx[p], ky[q])), int(max(kx[p], ky[q])), int(cx[p]), int(cy[q])))
        yield from tree(pairs) if spanning else ((a, b) for _, a, b, _, _ in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: set[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        group, found = [], set()
        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["sig"], r["i"], r["j"]) != (group[0]["sig"], group[0]["i"], group[0]["j"]):
                    found.update(compare(group))
                    group = []
                group.append(r)
            yield out(found)
            found = set()
        yield out(set(compare(group)) if group else set())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def open_buckets(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, blocks): the buckets (sig, k, many) whose sets are in several components, and their number of blocks."""
    labelled = wide.join(labels.hint("merge"), "k").groupBy("sig")
    ends = labelled.agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("many").alias("many"))
    return ends.filter("c0 <> c1").select("sig", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))


def relabelled(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels (k, component) after the edges (a, b) between sets unite components; works on the components' graph."""
    of = lambda v: labels.select(F.col("k").alias(v), F.col("component").alias(f"c{v}"))
    between = edges.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between, scratch).select(F.col("vertex").alias("component"), F.col("component").alias("into"))
    return labels.join(joined, "component", "left").select("k", F.coalesce("into", "component").alias("component"))


def join(docs: DataFrame, scratch: Scratch, like: Similarity = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; besides t, a hash of its text, and component, which
    names its component whatever the ids (null for an empty set)."""
    sets = scratch.save(documents_as_sets(docs, like), "sets")
    texts = texts_of(docs, sets, scratch)
    index = scratch.save(signatures(texts, allocate(texts, like), like), "signatures")
    met = scratch.save_parts((buckets_of(index, i) for i in range(ROUNDS)), "buckets")
    pairs = met.filter("k <> least").select(F.col("least").alias("a"), F.col("k").alias("b")).distinct()
    pairs = scratch.save(maybe_linked(pairs, index, like), "star-pairs")
    edges = scratch.save(verify(pairs, texts, like), "star-edges")
    named = components(edges, scratch).withColumnRenamed("vertex", "k")
    labels = texts.select("k").join(named, "k", "left").select("k", F.coalesce("component", "k").alias("component"))
    labels = scratch.save(labels, "labels")
    # Twice for buckets of three sets or more that are still in several components: first along spanning
    # trees of their likely pairs, then all pairs left across components.
    wide = met.filter("many > 2").select("sig", "k", "many")
    parts = [wide.filter(F.pmod("sig", F.lit(ROUNDS)) == i) for i in range(ROUNDS)]
    for spanning in (True, False):
        open_ = scratch.save_parts((open_buckets(rows, labels) for rows in parts), "open")
        if not open_.take(1):
            break
        named = scratch.save(labels.join(index.select("k", "n", "bits"), "k"), "named")
        mixed = (rows.select("sig", "k").join(open_, "sig").join(named, "k") for rows in parts)
        found = scratch.save_parts((cross_pairs(rows, spanning, like) for rows in mixed), "cross-pairs-of-parts")
        more = scratch.save(found.distinct().join(pairs, ["a", "b"], "left_anti"), "cross-pairs")
        scratch.drop(named, found)
        pairs = pairs.unionByName(more)
        edges = scratch.save(verify(more, texts, like), "cross-edges")
        if edges.take(1):
            labels = scratch.save(relabelled(labels, edges, scratch), "labels")
    members = sets.filter("n > 0").join(labels, "k", "left").withColumn("component", F.coalesce("component", "k"))
    ids = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked_rows = members.join(ids, "component").select("doc_id", "n", "component_id", "t", "component")
    alone = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "t", F.lit(None).cast("long").alias("component"))
    return linked_rows.unionByName(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, scratch: Scratch, like: Similarity = BANDS) -> DataFrame:
    """The documents, of each component only the one with the least doc_id (of equal ids: the least text hash).

    Documents with an empty set all stay. Of rows that repeat the kept one, one stays.
    """
    steps = scratch.part("join")
    rows = scratch.save(join(docs, steps, like), "rows")
    steps.drop()  # the index and all else that only the join reads
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    best = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.t").alias("_t"))
    empty = rows.filter("component IS NULL").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    stay = best.withColumn("_empty", F.lit(False)).unionByName(empty.distinct().withColumn("_empty", F.lit(True)))
    stay = scratch.save(stay, "stay")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t"))
    kept = docs.join(stay, same).drop("_id", "_t")
    many = rows.filter("component IS NOT NULL").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if many.limit(1).count():
        full = kept.filter("_empty").drop("_empty")
        return kept.filter("NOT _empty").drop("_empty").dropDuplicates(["doc_id", "text"]).unionByName(full)
    return kept.drop("_empty")
