"""Exact removal of long repeated strings by prefix-free parsing.

Every string of ``length`` bytes has a trigger: the place of the smallest rolling hash of TRIGGER bytes in
it, the rightmost of equals. Triggers cut a text into phrases: a phrase is all strings with one trigger,
that is, a run of starts, together with the bytes they cover. Equal strings have their trigger at the same
place, so phrases depend on content only. The parse is the list of all phrases, the dictionary the distinct
ones with their counts in the parse.

A string occurs as often as the dictionary phrases that contain it occur in the parse. No suffix array is
built, neither of the dictionary nor of the parse nor of the corpus: classes of equal hashes replace them. A
phrase that the parse has twice repeats in all its strings. The strings of the others are grouped by hash only
where another phrase has the same trigger string; those equal to a string of another phrase repeat.

Strings are compared as 64-bit rolling hashes next to an independent 64-bit hash of the trigger string.

Defined results: null texts are empty; texts shorter than ``length`` keep all bytes; rows with equal texts
repeat each other (so do repeated rows); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, utf8
from .wordhash import GOLDEN, mix

LENGTH = 200
TRIGGER = 48
#: Strings parsed together; more bytes of a text, or several texts, make several runs.
RUN = 1 << 18
_PLACES = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 * 2 + 1
_VALUES = mix(np.arange(1001, 1257, dtype=np.uint64) * GOLDEN)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Rolling:
    """Rolling hashes of a byte array for lengths that are sums of powers of two."""

    def __init__(self, data: np.ndarray, upto: int):
        self.by_length = {1: _VALUES[data]}
        n = 1
        while 2 * n <= upto:
            h = self.by_length[n]
            self.by_length[2 * n] = h[:-n] * _power(n) + h[n:]
            n *= 2

    def at(self, places: np.ndarray | slice, length: int) -> np.ndarray:
        """Hashes of the strings of that length that start at the given places."""
        if isinstance(places, slice):
            places = np.arange(places.start, places.stop)
        out, done = None, 0
        for n in sorted(self.by_length, reverse=True):
            if length - done >= n:
                part = self.by_length[n][places + done]
                out = part if out is None else out * _power(n) + part
                done += n
        return out


def phrases(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(first start, last start, trigger place less first start, trigger hash, phrase hash) of the phrases of a byte array.

    ``valid``: for each start, whether the string lies in one text.
    """
    rolling = Rolling(data, max(length, trigger))
    n = len(data) - trigger + 1
    grams = mix(rolling.at(slice(0, n), trigger))
    places = np.arange(n, dtype=np.uint64)
    least = (grams & ~_PLACES) | (_PLACES - places)
    window, width = length - trigger + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    at = (_PLACES - (least & _PLACES)).astype(np.int64)
    starts = np.flatnonzero(valid[: len(at)])
    at = at[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    lo, hi, at = starts[first], starts[last], at[first]
    # Two strings cover the whole phrase, as its starts are less than a string apart.
    shape = ((hi - lo) * length + (at - lo)).astype(np.uint64)
    whole = mix(mix(rolling.at(lo, length) + GOLDEN) + rolling.at(hi, length) * GOLDEN + shape)
    return lo, hi, at - lo, grams[at], whole


#: Starts of a phrase are compared in blocks of so many, counted back from its trigger.
BLOCK = 16


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text and its key: hash and length in bytes."""
    raw = utf8(F.col("text"))
    return docs.select("doc_id", F.xxhash64(raw).alias("t"), F.octet_length(raw).alias("n"), F.coalesce("text", F.lit("")).alias("text"))


def _runs(raws: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, place in the text, bytes) of parts to parse together; a long text's parts overlap by a string less one."""
    rows, at, parts, size = [], [], [], 0
    for row, raw in enumerate(raws):
        for start in range(0, max(len(raw) - length + 1, 0), RUN):
            part = raw[start : start + RUN + length - 1]
            rows.append(row), at.append(start), parts.append(part)
            size += len(part)
            if size >= RUN:
                yield rows, at, parts
                rows, at, parts, size = [], [], [], 0
    if rows:
        yield rows, at, parts


def parse(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The parse: one row per phrase, with its text's key, first start, number of starts and trigger place less first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x.encode() for x in batch["text"].to_pylist()]
            for rows, at, parts in _runs(raws, length):
                data = np.frombuffer(b"".join(parts), np.uint8)
                sizes = np.array([len(p) for p in parts])
                begins = np.cumsum(sizes) - sizes
                valid = np.zeros(len(data), bool)
                for b, size in zip(begins.tolist(), sizes.tolist(), strict=True):
                    valid[b : b + size - length + 1] = True
                lo, hi, lead, trigger, whole = phrases(data, valid, length)
                part = np.searchsorted(begins, lo, "right") - 1
                row = pa.array(np.array(rows)[part])
                first = lo - begins[part] + np.array(at)[part]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(row), batch["t"].take(row), batch["n"].take(row)]
                    + [pa.array(x.astype(np.int32)) for x in (first, hi - lo + 1, lead)]
                    + [pa.array(x.view(np.int64)) for x in (trigger, whole)],
                    ["doc_id", "t", "n", "lo", "starts", "lead", "h", "c"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "t", "n", "text").mapInArrow(
        run, f"doc_id {kind}, t long, n int, lo int, starts int, lead int, h long, c long"
    )


def _slices(raw: bytes, items: list[dict], length: int) -> Iterator[tuple[int, Rolling, dict[str, np.ndarray]]]:
    """Runs of neighbouring items of a text: where their bytes begin, the bytes' hashes, the items by column."""
    items = sorted(items, key=lambda x: x["lo"])
    first = 0
    while first < len(items):
        last = first + 1
        while last < len(items) and items[last]["lo"] - items[first]["lo"] < RUN:
            last += 1
        some, first = items[first:last], last
        begin = max(some[0]["lo"] - BLOCK, 0)
        end = max(x["lo"] + x["starts"] for x in some) + length
        cols = {c: np.array([x[c] for x in some]) for c in some[0]}
        yield begin, Rolling(np.frombuffer(raw[begin:end], np.uint8), length), cols


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... of each range, with the range each belongs to."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _with_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each text that items (doc_id, t, n, ...) belong to, with the list of its items."""
    kept = [c for c in items.columns if c not in ("doc_id", "t", "n")]
    lists = items.groupBy("doc_id", "t", "n").agg(F.collect_list(F.struct(*kept)).alias("items"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("n").alias("_n"), "items")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["t"] == F.col("_t")) & (docs["n"] == F.col("_n"))
    return docs.join(lists, same).select("doc_id", "t", "n", "text", "items")


def phrase_blocks(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Blocks of starts of dictionary phrases: BLOCK starts at a fixed distance j from the trigger.

    ``core`` names the bytes that all strings of the block share, ``whole`` all bytes of a block that lies
    inside its phrase (else null). Blocks of two phrases have a string in common only if their cores are
    equal, and have all in common if they are equal as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, items) in enumerate(zip(batch["text"].to_pylist(), batch["items"].to_pylist(), strict=True)):
                for begin, rolling, x in _slices(text.encode(), items, length):
                    lo, hi = x["lo"], x["lo"] + x["starts"] - 1
                    at = lo + x["lead"]
                    nearest, farthest = (at - hi) // BLOCK, (at - lo) // BLOCK
                    p, j = _ranges(nearest, farthest - nearest + 1)
                    last = at[p] - j * BLOCK
                    first = last - BLOCK + 1
                    core = mix(rolling.at(last - begin, length - BLOCK + 1) + j.astype(np.uint64) * GOLDEN)
                    inside = (first >= lo[p]) & (last <= hi[p])
                    whole = mix(
                        mix(rolling.at(np.where(inside, first - begin, 0), length) + GOLDEN)
                        + rolling.at(np.where(inside, last - begin, 0), length) * GOLDEN
                    )
                    start, stop = np.maximum(first, lo[p]), np.minimum(last, hi[p])
                    m = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch[c].take(pa.array(np.full(m, i))) for c in ("doc_id", "t", "n")),
                            pa.array(start.astype(np.int32)),
                            pa.array((stop - start + 1).astype(np.int32)),
                            pa.array(x["single"][p].astype(bool)),
                            pa.array(x["h"][p]),
                            pa.array(core.view(np.int64)),
                            pa.array(whole.view(np.int64), mask=~inside),
                        ],
                        ["doc_id", "t", "n", "lo", "starts", "single", "h", "core", "whole"],
                    )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        run, f"doc_id {kind}, t long, n int, lo int, starts int, single boolean, h long, core long, whole long"
    )


def strings(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """All strings of the given runs of starts: trigger hash, string hash, text key, start, whether an answer is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, items) in enumerate(zip(batch["text"].to_pylist(), batch["items"].to_pylist(), strict=True)):
                for begin, rolling, x in _slices(text.encode(), items, length):
                    p, start = _ranges(x["lo"], x["starts"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch[c].take(pa.array(np.full(len(p), i))) for c in ("t", "n")),
                            pa.array(start.astype(np.int32)),
                            pa.array(x["wanted"][p].astype(bool)),
                            pa.array(x["h"][p]),
                            pa.array(mix(rolling.at(start - begin, length)).view(np.int64)),
                        ],
                        ["t", "n", "lo", "wanted", "h", "w"],
                    )

    return texts.mapInArrow(run, "t long, n int, lo int, wanted boolean, h long, w long")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(t, n, spans): by text key, the runs (lo, starts) of starts of strings that also start elsewhere.

    Each table of the steps goes as soon as nothing reads it any more.
    """
    keyed = _keyed(docs)
    parsed = scratch.save(parse(keyed.filter(F.col("n") >= length), length), "parse")
    example = [F.first(c).alias(c) for c in ("doc_id", "t", "n", "lo", "starts", "lead")]
    dictionary = scratch.save(parsed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("many"), *example), "dictionary")
    # Phrases that the parse has several times.
    twice = dictionary.filter("many > 1").select("h", "c")
    whole = scratch.save(parsed.join(twice, ["h", "c"]).select("t", "n", "lo", "starts").distinct(), "whole")
    scratch.drop(parsed)
    # Phrases that share their trigger string with another, in blocks of starts.
    shared = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("phrases")).filter("phrases > 1").select("h")
    open_ = dictionary.join(shared, "h").select("doc_id", "t", "n", "lo", "starts", "lead", "h", (F.col("many") == 1).alias("single"))
    blocks = scratch.save(phrase_blocks(_with_texts(keyed, open_), length), "blocks")
    scratch.drop(dictionary)
    cores = blocks.groupBy("h", "core").agg(F.count(F.lit(1)).alias("same_core")).filter("same_core > 1")
    wholes = blocks.filter("whole IS NOT NULL").groupBy("h", "whole").agg(F.count(F.lit(1)).alias("same_whole")).filter("same_whole > 1")
    met = blocks.join(cores, ["h", "core"]).join(wholes, ["h", "whole"], "left")
    met = scratch.save(met.withColumn("wanted", F.expr("single AND same_whole IS NULL")), "met-blocks")
    scratch.drop(blocks)
    equal = met.filter("single AND same_whole IS NOT NULL").select("t", "n", "lo", "starts")
    # Blocks that share a core with a block not yet decided, string by string.
    undecided = met.filter("wanted").select("h", "core").distinct()
    rest = met.join(undecided, ["h", "core"], "left_semi").select("doc_id", "t", "n", "lo", "starts", "h", "wanted")
    each = scratch.save(strings(_with_texts(keyed, rest), length), "strings")
    again = each.groupBy("h", "w").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("h", "w")
    single = each.filter("wanted").join(again, ["h", "w"]).select("t", "n", "lo", F.lit(1).alias("starts"))
    runs = whole.unionByName(equal).unionByName(single)
    spans = scratch.save(runs.groupBy("t", "n").agg(F.collect_list(F.struct("lo", "starts")).alias("spans")), "spans")
    scratch.drop(whole, met, each)
    return spans


def _removed(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover, as (begin, end)."""
    if not spans:
        return []
    lo = np.array([x["lo"] for x in spans])
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], (lo + np.array([x["starts"] for x in spans]) + length - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return list(zip(lo[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(lo) - 1]])].tolist(), strict=True))


def remove(docs: DataFrame, spans: DataFrame, passed: tuple[str, ...] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """The passed columns of each document with n_bytes, n_removed, n_spans, kept_sha256 and kept.

    kept_sha256 is that of the bytes left; kept is their text, without characters that lost some of their bytes.
    """
    raw = utf8(F.col("text"))
    docs = docs.select(*passed, raw.alias("_raw"))
    lists = spans.select(F.col("t").alias("_t"), F.col("n").alias("_n"), F.col("spans").alias("_spans"))
    same = (F.xxhash64("_raw") == F.col("_t")) & (F.octet_length("_raw") == F.col("_n"))
    joined = docs.join(lists, same, "left").drop("_t", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found in zip(batch["_raw"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
                cuts = _removed(found, length)
                ends = [0, *(e for _, e in cuts)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(b for b, _ in cuts), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in passed), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))],
                [*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return joined.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
