"""Packing documents into token windows by non-negative least squares.

Documents are cut into full windows and a rest. Rests fall into length classes: up to 8 * GRAIN tokens each
length is one; from there on a class is 2 tokens wide, then 4, then GRAIN, at most a 32nd of its length. The
combinations are shallow: up to DEPTH pieces of any classes, many of one short class with one or several of
another, or four or five of the classes between, that fill a window. Non-negative least squares gives
how often to use each so that the class histogram is met; counts are rounded down and the classes left over are
packed greedily, largest first. The histogram and the combinations have a fixed size; pieces find their place
by their rank in their class, so nothing else leaves the tasks.

Defined results: a null text is empty, and an empty text is one piece of one end token; repeated rows
are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

WINDOW = 2048
GRAIN = 8
DEPTH = 3
END = 1
#: Ranks in a class are counted in parts of so many pieces; a class of some thousands has LEAST_PARTS even so.
PART_PIECES, LEAST_PARTS = 1 << 18, 64
#: Entries of a task's cache of encoded words, which then starts anew.
CACHE_WORDS = 200_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Token ids of whole texts as little-endian 32-bit bytes, through a cache by word.

    The vocabulary's splitting rule always starts a new part at a blank that a visible character follows.
    So a text in which each blank is followed by one can be encoded word by word (a word here carries the
    blank before it). Texts with other blanks, or with the marker of special tokens, are encoded whole.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        import base64

        import tiktoken

        self.tokenizer, self._whole = tokenizer, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.parts = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def whole(self):
        """The tokenizer itself, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.tokenizer)
        return self._whole

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace():
            return None
        if len(word) > 1 and word[-1] in ",." and word[:-1].isalpha():
            ids = self[word[:-1]] + self._bytes(self.parts.encode_ordinary(word[-1]))
        else:
            ids = self._bytes(self.parts.encode_ordinary(" " + word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            first, *words = text.split(" ")
            try:
                return self._bytes(self.parts.encode_ordinary(first)) + b"".join(map(self.__getitem__, words))
            except TypeError:  # a blank that no visible character follows
                pass
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Encoder:
    """The worker's encoder; it is kept between tasks, but for its cache of words."""
    if (tokenizer, ranks) not in _ENCODERS:
        _ENCODERS[tokenizer, ranks] = Encoder(tokenizer, ranks)
    return _ENCODERS[tokenizer, ranks]


def cut(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, window: int = WINDOW) -> DataFrame:
    """One row per piece of each document, with the checksum of its ids; a document's last id is END."""
    end = np.array([END], "<u4").tobytes()

    def pieces(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total = [], [], [], [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            ids = enc.encode(text) + end
            n = len(ids) // 4
            for at in range(0, n, window):
                part = ids[4 * at : 4 * (at + window)]
                row.append(i), start.append(at), length.append(len(part) // 4)
                crc.append(zlib.crc32(part)), total.append(n)
        longs = (pa.array(x, pa.int64()) for x in (start, length, crc, total))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(row, pa.int64())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scenaria.llm.packing import encoder

        enc = encoder(tokenizer, ranks)
        try:
            for batch in batches:
                yield pieces(enc, batch)
        finally:
            enc.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active sets, normal equations)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    col, row = np.nonzero(a.T)  # columns have few entries
    entries, columns = a[row, col], np.ascontiguousarray(a.T)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        residual = b - x[active] @ columns[active]
        gain = np.bincount(col, entries * residual[row], n)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            s = np.zeros(n)
            part = columns[active]
            square = part @ part.T
            square[np.diag_indices_from(square)] += 1e-12
            s[active] = np.linalg.solve(square, part @ b)
            below = active & (s <= 0)
            if not below.any():
                break
            ratio = x[below] / np.maximum(x[below] - s[below], 1e-300)
            x += ratio.min() * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                s[:] = 0
                break
        x = s
    return x


def size_class(length: Column, window: int = WINDOW, grain: int = GRAIN) -> Column:
    """A piece's class: the longest length in it, which stands for all its pieces when windows are filled."""
    width, out = grain, F.ceil(length / grain) * grain
    while width > 1:
        width //= 2
        out = F.when(length <= 8 * grain * width, F.ceil(length / width) * width).otherwise(out)
    return F.least(out, F.lit(window)).cast("int")


def combinations(present: list[int], full: int, depth: int = DEPTH) -> list[dict[int, int]]:
    """Shallow combinations of the classes present, as pieces by class, that fill a window of ``full`` tokens.

    Short are classes of which more than ``depth`` pieces fit. Exact are: up to ``depth`` pieces of any classes;
    pieces of a short class with one of a longer class, or with several of another short one (the most even numbers
    of each); two pieces of a short class, one or two of another and one of a third; ``depth`` pieces of the longest
    short classes and one that fills the rest. Besides, for each short class as many pieces as fit and the longest
    one that fits beside them, if no more than a hundredth of the window stays empty.
    """
    known = set(present)
    found = {}

    def add(*pieces: tuple[int, int]) -> None:
        combo: dict[int, int] = {}
        for u, n in pieces:
            combo[u] = combo.get(u, 0) + n
        found[tuple(sorted(combo.items()))] = combo

    for k in range(1, depth):
        for c in combinations_with_replacement(present, k):
            rest = full - sum(c)
            if rest in known and rest >= c[-1]:
                add(*((u, 1) for u in (*c, rest)))
    short = [u for u in present if u * (depth + 1) <= full]
    middling = [u for u in short if u * 64 > full]
    for i, u in enumerate(middling):
        for v in middling[i + 1 :]:
            exact = [n for n in range(1, full // u) if n * u < full and (full - n * u) % v == 0]
            if exact:
                n = min(exact, key=lambda n: abs(2 * n * u - full))
                add((u, n), (v, (full - n * u) // v))
    few = [u for u in short if u * 8 > full]
    for u in few:
        for v in few:
            for n in (1, 2):
                rest = full - 2 * u - n * v
                if u != v and rest * (depth + 1) <= full and rest in known:
                    add((u, 2), (v, n), (rest, 1))
    for c in combinations_with_replacement([u for u in short if u * (depth + 2) > full], depth):
        if full - sum(c) in known:
            add(*((u, 1) for u in c), (full - sum(c), 1))
    for u in short:
        room = full % u
        beside = present[bisect_right(present, room) - 1] if room >= present[0] else 0
        if (room - beside) * 100 <= full:
            add((u, full // u), *([(beside, 1)] if beside else []))
        for long in present[bisect_right(present, u) :]:
            if long < full and (full - long) % u == 0:
                add((u, (full - long) // u), (long, 1))
    return list(found.values())


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes and how often to use each; together they use up the histogram.

    ``histogram[u]``: pieces of class u, for 1 to the window's length.
    """
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    uses: list[tuple[tuple[int, ...], int]] = []

    def use(combo: dict[int, int], most: int) -> None:
        times = min(most, *(int(left[u]) // n for u, n in combo.items()))
        if times > 0:
            uses.append((tuple(u for u in sorted(combo, reverse=True) for _ in range(combo[u])), times))
            for u, n in combo.items():
                left[u] -= n * times

    use({full: 1}, int(left[full]))
    present = np.flatnonzero(left)
    combos = combinations(present.tolist(), full, depth)
    if combos:
        place = {u: i for i, u in enumerate(present.tolist())}
        a = np.zeros((len(present), len(combos)))
        for j, combo in enumerate(combos):
            for u, n in combo.items():
                a[place[u], j] = n
        weight = present / full  # longer pieces are harder to place later
        a *= weight[:, None]
        length = np.linalg.norm(a, axis=0)  # columns of one length, whether of few pieces or of many
        x = nnls(a / length, left[present] * weight) / length
        for j in np.argsort(-x, kind="stable"):
            use(combos[j], int(x[j]))
    while left.any():
        combo, room = {}, full
        for u in np.flatnonzero(left)[::-1].tolist():
            n = min(int(left[u]), room // u)
            if n:
                combo[u] = n
                room -= n * u
        use(combo, int(left.sum()))
    return uses


def pack(pieces: DataFrame, scratch: Scratch, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` is read twice: it should be a written table."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_class", size_class(F.col("length"), window, grain))
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect():  # at most a row per class
        histogram[r["_class"]] = r["n"]
    # Parts by class: so few in all that their starts can be broadcast, so many that none grows with the table.
    n_parts = [max(-(-n // PART_PIECES), min(LEAST_PARTS, -(-n // LEAST_PARTS)), 1) for n in histogram.tolist()]
    n_parts = F.element_at(F.array(*map(F.lit, n_parts)), F.col("_class") + 1)
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), n_parts).cast("int"))
    parts = scratch.save(pieces.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("n")), "classes")
    ranges, next_rank, sequences = [], [0] * len(histogram), 0
    for combo, times in plan(histogram, depth):
        for u in dict.fromkeys(combo):
            many = combo.count(u)
            ranges.append((u, next_rank[u], next_rank[u] + many * times, many, combo.index(u), sequences))
            next_rank[u] += many * times
        sequences += times
    table = spark.createDataFrame(ranges, "_class int, _from long, _to long, _many long, _place long, _first long")
    starts = parts.select(
        "_class", "_part", (F.sum("n").over(Window.partitionBy("_class").orderBy("_part")) - F.col("n")).alias("_start")
    )
    within = Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "ids_crc32")
    at = F.col("_rank") - F.col("_from")
    placed = (
        pieces.withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["_class", "_part"])
        .withColumn("_rank", F.col("_start") + F.col("_row"))
        .join(F.broadcast(table), "_class")
        .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_many")))
        .withColumn("_place", F.col("_place") + at % F.col("_many"))
    )
    before = Window.partitionBy("sequence_id").orderBy("_place")
    offset = F.sum("length").over(before) - F.col("length")
    return placed.withColumn("offset", offset.cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), "offset"
    )
