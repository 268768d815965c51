"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 3. Where a context has not seen a byte, it escapes to the
next shorter one (method C: the escape weighs as much as the context has distinct bytes; bytes of longer
contexts are excluded), down to an even code over the bytes left. With frozen counts, the code length of
a byte depends on the last four bytes only, so it is worked out once for each context, byte and language;
a text's exact code length in each language is a sum of table entries over the whole text.

Trees are learned from a bounded sample of the labelled texts: at most about ``max_train_bytes`` per
language, drawn by a hash of the row (all rows of a language below that). All contexts of the sample are kept;
a caller may set ``max_contexts`` to keep the most frequent ones of order 3 only.

How many bits a byte a language's own texts take is measured on all labelled texts, each with trees that have not
seen it (``usual_rates``); texts far above it are in none of the learned languages.

Defined results: null texts and texts without a letter are ``und`` with score 0; languages tie by name;
equal texts get equal results; an empty table or one without labels gives ``und`` throughout.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
#: Texts are scored in runs of so many bytes; longer texts in segments that see the bytes before them.
RUN_BYTES = 1 << 17
UNKNOWN = "und"
#: Bits a byte are measured on texts of so many bytes, and of a language with so many of them.
RATED_BYTES, RATED_TEXTS = 200, 100
MAX_TRAIN_BYTES = 4_000_000


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of (row, bytes) segments; each segment has the ORDER bytes before it, zero at a text's start."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if not text or not LETTER.search(text):
            continue
        raw = bytes(ORDER) + text.lower().encode().replace(b"\0", b"\x01")
        for at in range(ORDER, len(raw), RUN_BYTES):
            part = raw[at - ORDER : at + RUN_BYTES]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= RUN_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; the places of the scored bytes' first and end in each segment."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return joined, np.concatenate([[0], ends[:-1]]) + ORDER, ends


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, four bytes) per batch."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for _, parts in _segments(texts):
                joined, starts, ends = _grams(parts)
                wide = joined.astype(np.uint32)
                code = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
                inside = np.zeros(len(joined) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                codes, counts = np.unique(code[np.cumsum(inside[:-1])[ORDER:] > 0], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(codes), "gram": codes.astype(np.int64), "n": counts.astype(np.int64)}
                )


def sample(labelled: DataFrame, max_train_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """The labelled texts that are learned from. ``labelled`` has text and lang, both non-null."""
    size = F.octet_length("text")
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.sum(size).alias("n")).collect() if r.n}
    share = F.lit(0.0)
    for lang, n in sorted(totals.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_train_bytes / n))).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20) < share).select("lang", "text")


def learn(drawn: DataFrame, max_contexts: int | None = None) -> Model:
    """The model of a sample, whose distinct four-byte counts come to the driver."""
    rows = (
        drawn.mapInArrow(count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        counts.setdefault(r.lang, []).append((r.gram, r.n))
    return Model(counts, max_contexts)


def train(labelled: DataFrame, max_train_bytes: int = MAX_TRAIN_BYTES, max_contexts: int | None = None) -> Model:
    return learn(sample(labelled, max_train_bytes), max_contexts)


def usual_rates(labelled: DataFrame, max_train_bytes: int = MAX_TRAIN_BYTES) -> dict[str, float]:
    """The most bits a byte of all labelled texts by language, each text under trees that have not seen it.

    Texts fall into halves by a hash; a text is measured with the trees of the other half's sample. Texts taken for
    another language than their label's count for none. Languages with fewer than RATED_TEXTS texts of RATED_BYTES
    bytes have none.
    """
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2))
    most: dict[str, float] = {}
    texts: dict[str, int] = {}
    drawn = sample(labelled, max_train_bytes)
    for i in (0, 1):
        rated = predict(labelled.filter((half == i) & (F.octet_length("text") >= RATED_BYTES)), learn(drawn.filter(half != i)), ("lang",))
        own = rated.filter("lang_pred = lang AND bits_per_byte IS NOT NULL").groupBy("lang")
        for r in own.agg(F.max("bits_per_byte").alias("most"), F.count(F.lit(1)).alias("n")).collect():
            most[r.lang], texts[r.lang] = max(most.get(r.lang, 0.0), r.most), texts.get(r.lang, 0) + r.n
    return {lang: rate for lang, rate in most.items() if texts[lang] >= RATED_TEXTS}


class Model:
    """Frozen context trees of all languages as two tables: context steps and code lengths."""

    def __init__(self, counts: dict[str, list[tuple[int, int]]], max_contexts: int | None = None):
        self.langs = sorted(counts)
        if not self.langs:
            return
        seen = sorted({(g >> s) & 255 for grams in counts.values() for g, _ in grams for s in (0, 8, 16, 24)} | {0})
        self.symbols = np.full(256, len(seen), np.uint8)  # the last symbol: bytes never seen
        self.symbols[seen] = np.arange(len(seen))
        width = len(seen) + 1
        grams = {}
        contexts: dict[tuple, int] = {}
        for lang in self.langs:
            arr = np.array(counts[lang], np.int64).reshape(-1, 2)
            syms = np.stack([self.symbols[(arr[:, 0] >> s) & 255] for s in (24, 16, 8, 0)], 1).astype(int)
            tree: dict[tuple, np.ndarray] = {}
            for *before, byte, n in np.column_stack([syms, arr[:, 1]]).tolist():
                for k in range(ORDER + 1):  # contexts nearest byte first: (), (b1,), (b1, b2), (b1, b2, b3)
                    context = tuple(before[::-1][:k])
                    if context not in tree:
                        tree[context] = np.zeros(width)
                    tree[context][byte] += n
                deepest = tuple(before[::-1])
                contexts[deepest] = contexts.get(deepest, 0) + n
            grams[lang] = tree
        kept = set(sorted(contexts, key=lambda c: (-contexts[c], c))[:max_contexts])
        nodes = sorted({c[:k] for c in kept for k in range(ORDER + 1)} | {()}, key=lambda c: (len(c), c))
        index = {c: i for i, c in enumerate(nodes)}
        inner = [c for c in nodes if len(c) < ORDER]
        # A step from a context by one byte more; a context that was not kept stops at the shorter one,
        # through a state from which all steps lead to itself.
        n_inner = len(inner)
        states = {c: i for i, c in enumerate(inner)} | {("stop", c): n_inner + i for i, c in enumerate(inner)}
        deep = {c: 2 * n_inner + i for i, c in enumerate(c for c in nodes if len(c) == ORDER)}
        step = np.zeros((2 * n_inner, width), np.int32)
        for c in inner:
            stop = states[("stop", c)]
            step[stop] = stop
            for s in range(width):
                longer = (*c, s)
                step[states[c], s] = deep.get(longer, states.get(longer, stop))
        row = np.zeros(2 * n_inner + len(deep), np.int64)
        for c in inner:
            row[states[c]] = row[states[("stop", c)]] = index[c]
        for c, i in deep.items():
            row[i] = index[c]
        self.width, self.step = width, step.ravel()
        lengths = np.zeros((len(nodes), width, len(self.langs)), np.float32)
        left = np.ones(width)
        left[-1] = max(256 - len(seen), 1)
        for k, lang in enumerate(self.langs):
            for c, i in index.items():
                lengths[i, :, k] = self._code_lengths(grams[lang], c, left)
        self.start_row = (row * width).astype(np.int32)
        self.lengths = lengths.reshape(-1, len(self.langs))

    @staticmethod
    def _code_lengths(tree: dict[tuple, np.ndarray], context: tuple, left: np.ndarray) -> np.ndarray:
        """Bits of each symbol after a context; ``left``: how many byte values a symbol stands for."""
        bits, open_, escape = np.zeros(len(left)), np.ones(len(left), bool), 0.0
        for k in range(len(context), -1, -1):
            n = tree.get(context[:k])
            if n is None:
                continue
            n = np.where(open_, n, 0)
            distinct = np.count_nonzero(n)
            if distinct:
                whole = n.sum() + distinct
                bits = np.where(n > 0, escape - np.log2(np.maximum(n, 1) / whole), bits)
                escape -= math.log2(distinct / whole)
                open_ &= n == 0
        return np.where(open_, escape + math.log2(max(left[open_].sum(), 1)), bits)

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each text in each language."""
        bits = np.zeros((len(texts), len(self.langs)))
        for rows, parts in _segments(texts):
            joined, starts, ends = _grams(parts)
            sym = self.symbols[joined]
            state = self.step[sym[2:-1]]  # from the empty context, whose state is 0
            state = self.step[state * self.width + sym[1:-2]]
            state = self.step[state * self.width + sym[:-3]]
            at = self.start_row[state] + sym[3:]
            cost = self.lengths[np.append(at, 0)]  # one row more, so that the last segment has an end
            edges = np.stack([starts - ORDER, ends - ORDER], 1).ravel()
            np.add.at(bits, rows, np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2])
        return bits


def predict(docs: DataFrame, model: Model, passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score (the language's share of the texts' likelihoods) and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            langs, scores, rates = [], [], []
            bits = m.code_lengths(texts) if m.langs else None
            for i, text in enumerate(texts):
                if bits is None or not text or not LETTER.search(text):
                    langs.append(UNKNOWN), scores.append(0.0), rates.append(None)
                    continue
                best = int(bits[i].argmin())
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp2(bits[i][best] - bits[i]).sum()))
                rates.append(float(bits[i][best] / len(text.lower().encode())))
            out = {c: batch[c] for c in passed}
            yield pa.RecordBatch.from_pydict(
                out | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "bits_per_byte": pa.array(rates, pa.float64())}
            )

    source = docs.select(*passed, "text") if "text" not in passed else docs.select(*passed)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def trainable(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
