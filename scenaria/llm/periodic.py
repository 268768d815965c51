"""Periodic runs in texts: string synchronising sets over words.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) whose length is
at least max(LEAST_LENGTH, LEAST_EXPONENT * q) and which no neighbouring word extends keeping the period.

Texts lie one after the other in one array of word numbers, a batch at a time, with a word of its own at
each text's end, so that nothing matches across texts. At each dyadic scale t = 2, 4, 8, ... every position
has a 64-bit identifier of its next t words, made from two of the scale before. A position i belongs to the
scale's synchronising set if the least hash among the positions i to i + t lies at i or at i + t; that
depends on the 2t words from i alone, so equal stretches of text have equal sets. Positions whose next t
words have a period of t / 4 or less are left out of the minimum: these highly periodic regions would make
the set dense, and the runs found at smaller scales say where they lie. Periods below SMALL come from
comparing the text with itself shifted, which supplies the periods that the sets leave out.

A run of period q in [t, 2t) has at least four periods, so a set position lies in its first t words and comes
again q words later with the same 2t words after it, and no nearer position has these 2t words. Neighbours
among equal contexts therefore propose every such period. Proposals that overlap are joined, extended word
by word to both sides, and compared exactly before they count; a stretch already found with a smaller period
is that run.

Defined results: null and empty texts have no words and no runs; a null id counts as the empty text where it
chooses the planted texts; repeated rows are treated one by one, empty tables give empty results, and of
other columns only those asked for are kept. A very long text is a batch of its own, with memory in
proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Periods below this come from shifted comparisons, larger ones from the synchronising sets.
SMALL = 8
#: Words of one batch of texts; a longer text is a batch of its own.
BATCH_WORDS = 200_000
#: Words compared at a time when proposals are extended.
STEP = 32

RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def plant(ids: np.ndarray, doc_id: str) -> np.ndarray:
    """Repeats a part of every tenth text, chosen by the crc32 of its id: the words from a on have period p."""
    h, n = zlib.crc32(doc_id.encode()), len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _true_stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.diff(same.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _extend(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extends stretches [lo, hi) in which the words d apart are equal as far as they go."""
    lo, hi, n = lo.copy(), hi.copy(), len(w)
    for end, sign in ((hi, 1), (lo, -1)):
        step = np.arange(STEP) if sign > 0 else -1 - np.arange(STEP)
        live = np.arange(len(end))
        while len(live):
            at = end[live, None] + step
            inside = (at >= 0) & (at + d[live, None] < n)
            at[~inside] = 0
            equal = inside & (w[at] == w[np.minimum(at + d[live, None], n - 1)])
            run = np.where(equal.all(1), STEP, np.argmin(equal, 1))
            end[live] += sign * run
            live = live[run == STEP]
    return lo, hi


def find_runs(w: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of the texts in ``w`` as rows (start, length, period), ordered by start, then period.

    ``w`` holds word numbers of 0 or more; ``ends`` the places of the texts' end marks, each of which is a
    number that occurs once in ``w``. Starts are places in ``w``.
    """
    n = len(w)
    found: dict[tuple[int, int], int] = {}

    def keep(lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> None:
        """Stretches of equality [lo, hi) at distance d, maximal; those of a period already known are dropped."""
        length = hi - lo + d
        for k in np.flatnonzero(length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * d)):
            found.setdefault((int(lo[k]), int(hi[k] + d[k])), int(d[k]))

    for d in range(1, min(SMALL, n)):
        lo, hi = _true_stretches(w[:-d] == w[d:])
        keep(lo, hi, np.full(len(lo), d))

    longest = int(np.diff(ends, prepend=-1).max(initial=1)) - 1
    ids, t = _mix(w.astype(np.uint64) + np.uint64(1)), 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    while LEAST_EXPONENT * t <= longest:
        if t >= SMALL:
            hashed = _mix(ids ^ np.uint64(t))
            hashed[hashed == top] -= np.uint64(1)
            # Highly periodic regions: the next t words lie in one run of period t / 4 or less.
            for (lo, hi), d in found.items():
                if 4 * d <= t <= hi - lo:
                    hashed[lo : hi - t + 1] = top
            least, k = hashed, 1  # least of the t positions from each on
            while k < t:
                least = np.minimum(least[:-k], least[k:])
                k *= 2
            m = n - 2 * t + 1  # positions with 2t words after them
            first, last = hashed[:m], hashed[t : t + m]
            least = np.minimum(least[:m], last)
            s = np.flatnonzero((least != top) & ((first == least) | (last == least)))
            context = _mix(ids[s] + np.uint64(0x9E3779B97F4A7C15)) ^ ids[s + t]
            order = np.lexsort((s, context))
            s, context = s[order], context[order]
            d = np.diff(s)
            ok = (context[1:] == context[:-1]) & (d >= t) & (d < 2 * t)
            s, d = s[:-1][ok], d[ok]
            if len(s):
                # Joins overlapping proposals of one period: each says that [s, s + 2t) equals what lies d on.
                order = np.lexsort((s, d))
                s, d = s[order], d[order]
                new = np.ones(len(s), bool)
                new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 2 * t)
                lo, d, hi = s[new], d[new], s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] + 2 * t
                lo, hi = _extend(w, lo, hi, d)
                long = hi - lo + d >= LEAST_EXPONENT * d
                for a, b, q in zip(lo[long], hi[long], d[long], strict=True):
                    if np.array_equal(w[a:b], w[a + q : b + q]):
                        keep(np.array([a]), np.array([b]), np.array([q]))
                    else:  # identifiers that met by chance: what really is equal in this stretch
                        x, y = _true_stretches(w[a:b] == w[a + q : b + q])
                        x, y = _extend(w, x + a, y + a, np.full(len(x), q))
                        keep(x, y, np.full(len(x), q))
        ids = np.concatenate([_mix(ids[:-t] * np.uint64(3) + np.uint64(t)) ^ ids[t:] * np.uint64(0x9E3779B97F4A7C15), ids[-t:]])
        t *= 2
    return np.array(sorted((a, b - a, d) for (a, b), d in found.items()), dtype=np.int64).reshape(-1, 3)


def _batches(texts: list[bytes], doc_ids: list[str], planted: bool) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Texts as lists of words and as word numbers, some BATCH_WORDS words at a time."""
    numbers: dict[bytes, int] = {}
    lists, arrays, total = [], [], 0
    for text, doc_id in zip(texts, doc_ids, strict=True):
        words = text.split()  # at the blanks \x20 and \x09 to \x0D
        if total and total + len(words) > BATCH_WORDS:
            yield lists, arrays
            numbers, lists, arrays, total = {}, [], [], 0
        ids = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
        if planted and len(words):
            # word numbers of the planted text, and its words by the first place of each number
            ids = plant(ids, doc_id)
            by_number = dict(zip((numbers[x] for x in words), words, strict=True))
            words = [by_number[i] for i in ids.tolist()]
        lists.append(words)
        arrays.append(ids)
        total += len(words)
    if lists:
        yield lists, arrays


def text_runs(texts: list[bytes], doc_ids: list[str], planted: bool = False) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each text its words and its runs (start, length, period)."""
    for lists, arrays in _batches(texts, doc_ids, planted):
        sizes = np.array([len(a) for a in arrays])
        ends = np.cumsum(sizes + 1) - 1
        w = np.empty(int(ends[-1]) + 1, np.int64)
        for a, e in zip(arrays, ends, strict=True):
            w[e - len(a) : e] = a
        w[ends] = int(sizes.sum()) + np.arange(len(ends))  # above every word number
        runs = find_runs(w, ends)
        cut = np.searchsorted(runs[:, 0], np.append(0, ends))
        for words, a, b, e in zip(lists, cut[:-1], cut[1:], ends, strict=True):
            yield words, runs[a:b] - np.array([e - len(words), 0, 0])


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    collapsed = words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(runs) else None
    return (
        len(words),
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed)).hexdigest(),
    )


def runs_of(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), planted: bool = False) -> DataFrame:
    """The runs of every text, one row each: ``columns``, start, length and period in words from 0."""
    kept = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("start", "length", "period"))])
    return docs.select(*columns, *_input(docs)).mapInArrow(_mapper(columns, planted, False), schema)


def collapse(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``collapsed``: every text's words joined by one blank, without what runs repeat."""
    kept = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*kept, T.StructField("collapsed", T.StringType())])
    return docs.select(*columns, *_input(docs)).mapInArrow(_collapser(columns), schema)


def summarise(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), planted: bool = False) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    kept = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*kept, *T.StructType.fromDDL(RESULT).fields])
    return docs.select(*columns, *_input(docs)).mapInArrow(_mapper(columns, planted, True), schema)


def _input(docs: DataFrame) -> list:
    text = F.coalesce(docs["text"], F.lit("")).cast("binary").alias("_text")
    return [text, F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("_id")]


def _collapser(columns: tuple[str, ...]):
    def run(batches):
        for b in batches:
            texts, ids = b.column("_text").to_pylist(), b.column("_id").to_pylist()
            out = []
            for words, runs in text_runs(texts, ids):
                keep = np.ones(len(words), bool)
                for start, length, period in runs.tolist():
                    keep[start + period : start + length] = False
                out.append(b" ".join(x for x, k in zip(words, keep.tolist(), strict=True) if k))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.binary()).cast(pa.string())], names=[*columns, "collapsed"])

    return run


def _mapper(columns: tuple[str, ...], planted: bool, summary: bool):
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            texts, ids = b.column("_text").to_pylist(), b.column("_id").to_pylist()
            found = list(text_runs(texts, ids, planted)) if not summary else None
            if summary:
                rows = [_digest(words, runs) for words, runs in text_runs(texts, ids, planted)]
                values = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                arrays = [pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, values, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *arrays], names=[*columns, *names])
            else:
                at = pa.array(np.repeat(np.arange(len(found)), [len(r) for _, r in found]))
                runs = np.concatenate([np.empty((0, 3), np.int64), *(r for _, r in found)])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in columns), *(pa.array(runs[:, i]) for i in range(3))], names=[*columns, "start", "length", "period"])

    return run
