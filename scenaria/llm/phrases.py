"""Phrase collocation mining by best-first branch-and-bound growth.

Texts are lower-cased in A-Z and cut into pieces at punctuation and line ends, pieces into words at blanks
and tabs. For each language, f(phrase) counts the places of a phrase within pieces, overlaps included.
Candidates are phrases of two or three words with f of LEAST_COUNT or more. Cut after its first k words, a
candidate with a = f has l = f(first part), r = f(rest) and the score floor(SCALE * a * a / (l * r)); its
lowest-scoring cut counts. A candidate that lies within a longer candidate of at least half its count is
dropped. The best ``top`` of what is left are the language's phrases.

Growth: words are counted first, then pairs of frequent words, then triples from a frontier of pairs. A
triple x y z has a <= f(x y) and a <= f(y z), so its score after the first cut is at most
SCALE * f(x y) / f(x): the counts of its prefix bound it. The same number bounds the pair's own score, so
prefixes are taken best bound first. A round goes down to a bound b of each language (the score of its
``top`` * 2-th pair at first, four times as many pairs in each round after): it counts all triples whose
prefix has a bound of b or more, which are all that can score b or more, and all that end in a pair of score
b or more, so that it is known for every pair above b whether a triple drops it. A language is settled when
``top`` candidates survive at or above b; nothing below b can come before them or tie with them. Others go
on, in the end down to 0.

A pass over the texts numbers the words of CHUNK words at a time and counts their phrases by sorting the
numbers; Spark adds up the chunks. Long texts are read SLICE bytes at a time, and the last two words go along
into the next chunk. Which pairs and triples a pass may leave out is known from one byte per crc32 slot of the words or pairs, a table of at most 2**MAX_BITS bytes. Two keys in
one slot only make a pass count more than needed, never less, and every count that is used is exact.
Scores are worked out in decimals of 38 digits, exact for counts up to 10**15.

Defined results: a null language is ``und``; null and empty texts have no words; repeated rows count each
time; tables without rows or without candidates give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST_COUNT = 10
TOP = 2000
SCALE = 1_000_000
#: Words whose phrases a task counts at a time, and bytes of a text read at a time.
CHUNK = 500_000
SLICE = 1_000_000
#: Slots of the tables of frequent words and pairs: 32 for each key, from 2**16 to 2**MAX_BITS bytes.
MAX_BITS = 24
#: Bits of a slot: the pair (or word) occurs LEAST_COUNT times; it is a prefix to expand; triples ending in it count.
FREQUENT, PREFIX, SUFFIX = 1, 2, 4

#: Tables of one row per language are broadcast up to so many rows.
FEW_LANGS = 10_000

#: All breaks become a stop, which then is a word of its own with number 0.
_BREAKS = bytes.maketrans(b",;:!?\n\r\x0b\x0c", b"." * 9)
COUNTS = "lang string, phrase binary, n long"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The text's lower-cased words and stops, a slice at a time; no word lies across slices."""
    text, at = text.lower().translate(_BREAKS), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\t", b"."))
            if cut < 0:  # a word longer than a slice
                cut = min((i for c in (b" ", b"\t", b".") if (i := text.find(c, end)) >= 0), default=len(text))
            end = cut + 1
        yield text[at:end].replace(b".", b" . ").split()
        at = end


class _Numbers(dict):
    """Numbers of words in the order they come; a stop is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    """Words of one language, numbered; the first ``seen`` of them were in a chunk before."""

    def __init__(self, carried: list[bytes] = ()):
        self.numbers = _Numbers({b".": 0})
        self.parts, self.seen = [np.array([0])], len(carried) + 1
        self.add(list(carried))

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))

    def last_words(self) -> list[bytes]:
        words, last = list(self.numbers), np.empty(0, np.int64)
        for part in reversed(self.parts):
            last = np.concatenate([part[-2:], last])[-2:]
            if len(last) == 2:
                break
        return [words[i] for i in last.tolist()]

    def counts(self, size: int, bits) -> tuple[list[bytes], np.ndarray]:
        """Phrases of ``size`` words and their counts. ``bits`` gives the slots' bits for a list of words or pairs.

        Pairs of two words that may be frequent; triples of two such pairs, whose first is a prefix to expand
        or whose last is one that triples may drop.
        """
        ids, words = np.concatenate(self.parts), list(self.numbers)
        v = len(words)
        if size == 1:
            n = np.bincount(ids[self.seen :], minlength=v)[1:]
            at = np.flatnonzero(n)
            return [words[i + 1] for i in at.tolist()], n[at]
        joined = lambda first, then: [a + b" " + words[j] for a, j in zip(first, then.tolist(), strict=True)]
        pick = lambda at: [words[i] for i in at.tolist()]
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        if size == 2:
            often = np.zeros(v, bool)
            often[1:] = bits(words[1:])
            pair[: max(0, self.seen - 1)] = False
            pair &= often[ids[:-1]] & often[ids[1:]]
            codes, n = np.unique(ids[:-1][pair] * v + ids[1:][pair], return_counts=True)
            return joined(pick(codes // v), codes % v), n
        codes, which = np.unique(ids[:-1][pair] * v + ids[1:][pair], return_inverse=True)
        phrases = joined(pick(codes // v), codes % v)
        here, number = np.zeros(len(pair), np.uint8), np.zeros(len(pair), np.int64)
        here[pair], number[pair] = bits(phrases)[which], which
        x, y = here[:-1], here[1:]
        triple = (x > 0) & (y > 0) & (((x & PREFIX) | (y & SUFFIX)) > 0)
        triple[: max(0, self.seen - 2)] = False
        codes, n = np.unique(number[:-1][triple] * v + ids[2:][triple], return_counts=True)
        return joined([phrases[i] for i in (codes // v).tolist()], codes % v), n


def slot_bits(table: bytes, lang: str):
    """Looks up the bits of words or pairs of a language by crc32."""
    start, mask, flat = zlib.crc32(lang.encode() + b"\0"), len(table) - 1, np.frombuffer(table, np.uint8)
    crc = zlib.crc32
    return lambda phrases: flat[np.fromiter((crc(p, start) for p in phrases), np.int64, len(phrases)) & mask]


def _slot(lang: Column, phrase: Column, bits: int) -> Column:
    return F.crc32(F.concat(lang.cast("binary"), F.lit(bytearray(1)), phrase)).bitwiseAND((1 << bits) - 1)


def slot_table(keys: DataFrame) -> bytes:
    """One byte per slot from rows (lang, phrase, bits); at most 2**MAX_BITS bytes reach the driver."""
    n = keys.count()
    size = min(MAX_BITS, max(16, (32 * n).bit_length()))
    slot = _slot(F.col("lang"), F.col("phrase"), size)
    # Eight slots in a long: at most 2**MAX_BITS / 8 rows.
    shifted = F.expr("shiftleft(CAST(bits AS BIGINT), CAST(8 * (slot % 8) AS INT))").alias("v")
    at = keys.withColumn("slot", slot).select(F.shiftright("slot", 3).alias("at"), shifted)
    rows = at.groupBy("at").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    table = np.zeros(1 << (size - 3), "<u8")
    table[rows.column("at").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return table.tobytes()


def _counter(size: int, slots=None):
    """Counts of phrases of ``size`` words by chunk; with slots, of those that they let through."""

    def run(batches):
        chunks: dict[str, _Chunk] = {}
        held = 0

        def counted():
            for lang, chunk in chunks.items():
                phrases, n = chunk.counts(size, slots and slot_bits(slots.value, lang))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                chunks.setdefault(lang, _Chunk()).add([b"."])
                for words in tokens(text):
                    chunks[lang].add(words)
                    held += len(words)
                    if held >= CHUNK:
                        yield from counted()
                        chunks, held = {lang: _Chunk(chunks[lang].last_words())}, 0
        yield from counted()

    return run


def count(texts: DataFrame, size: int, slots=None) -> DataFrame:
    """(lang, phrase, n): how often phrases of ``size`` words occur, of those at least that ``slots`` let through."""
    parts = texts.mapInArrow(_counter(size, slots), COUNTS)
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _part(phrase: str, start: int, size: int) -> Column:
    """``size`` words of a phrase from word ``start``, as binary."""
    words = F.slice(F.split(F.col(phrase).cast("string"), " ", -1), start + 1, size)
    return F.concat_ws(" ", words).cast("binary")


def _score(a: str, lr: tuple[str, str]) -> Column:
    return F.expr(
        f"CAST((CAST({SCALE} AS DECIMAL(7,0)) * (CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))))"
        f" DIV (CAST({lr[0]} AS DECIMAL(18,0)) * CAST({lr[1]} AS DECIMAL(18,0))) AS BIGINT)"
    )


def _with(df: DataFrame, key: Column, counts: DataFrame, name: str) -> DataFrame:
    """Adds the count of a part of the phrase."""
    part = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_key"), F.col("n").alias(name))
    df = df.withColumn("_part", key)
    return df.join(part, (df["lang"] == part["_lang"]) & (df["_part"] == part["_key"])).drop("_lang", "_key", "_part")


def _by_lang(df: DataFrame, small: DataFrame, n_langs: int, how: str = "inner") -> DataFrame:
    """Joins with one row per language; broadcast where the languages are few, so that no language is one task."""
    return df.join(F.broadcast(small) if n_langs <= FEW_LANGS else small, "lang", how)


def mine(docs: DataFrame, scratch: Scratch, top: int = TOP, least: int = LEAST_COUNT) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    words = scratch.save(count(texts, 1), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= least)

    slots = spark.sparkContext.broadcast(slot_table(often.select("lang", "phrase", F.lit(FREQUENT).alias("bits"))))
    pairs = count(texts, 2, slots).filter(F.col("n") >= least)
    pairs = _with(_with(pairs, _part("phrase", 0, 1), often, "l"), _part("phrase", 1, 1), often, "r")
    pairs = pairs.withColumn("score", _score("n", ("l", "r"))).withColumn("bound", F.expr(f"CAST({SCALE} * CAST(n AS DECIMAL(18,0)) DIV l AS BIGINT)"))
    pairs = scratch.save(pairs, "pairs")
    slots.destroy()

    # Score levels of the pairs: how many pairs of the language score as much or more.
    levels = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("here"))
    above = F.sum("here").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    levels = scratch.save(levels.select("lang", "score", above.alias("above")), "levels")
    open_langs, done, goal = scratch.save(levels.select("lang").distinct(), "open"), None, 2 * top
    n_langs = open_langs.count()
    while True:
        bounds = _by_lang(levels, open_langs, n_langs).groupBy("lang").agg(F.max(F.when(F.col("above") >= goal, F.col("score"))).alias("b"))
        bounds = scratch.save(bounds.select("lang", F.coalesce("b", F.lit(0)).alias("b")), "bounds")
        if not bounds.take(1):
            break
        here = _by_lang(pairs, bounds, n_langs)
        bits = F.lit(FREQUENT) + F.when(F.col("bound") >= F.col("b"), PREFIX).otherwise(0) + F.when(F.col("score") >= F.col("b"), SUFFIX).otherwise(0)
        slots = spark.sparkContext.broadcast(slot_table(here.select("lang", "phrase", bits.alias("bits"))))
        # Texts of settled languages are left out by their slots, whose bits are unset.
        triples = count(texts, 3, slots).filter(F.col("n") >= least)
        parts = _with(_with(triples, _part("phrase", 0, 2), pairs, "n12"), _part("phrase", 1, 2), pairs, "n23")
        parts = _with(_with(parts, _part("phrase", 0, 1), often, "n1"), _part("phrase", 2, 1), often, "n3")
        parts = parts.withColumn("s1", _score("n", ("n1", "n23"))).withColumn("s2", _score("n", ("n12", "n3")))
        first = F.col("s1") <= F.col("s2")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        triples = scratch.save(parts.select("lang", "phrase", "n", pick("n1", "n12").alias("l"), pick("n23", "n3").alias("r"), pick("s1", "s2").alias("score")), "triples")
        slots.destroy()

        inner = triples.select("lang", F.explode(F.array(_part("phrase", 0, 2), _part("phrase", 1, 2))).alias("phrase"), "n")
        cover = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        here = here.filter(F.col("score") >= F.col("b")).join(cover, ["lang", "phrase"], "left")
        here = here.filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("n")))
        columns = ["lang", "phrase", "n", "l", "r", "score"]
        kept = here.select(*columns, "b").unionByName(_by_lang(triples, bounds, n_langs).filter(F.col("score") >= F.col("b")).select(*columns, "b"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), F.asc("phrase"))
        ranked = scratch.save(kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "ranked")
        settled = bounds.join(ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("got")), "lang", "left")
        settled = settled.filter((F.col("b") == 0) | (F.col("got") >= top)).select("lang")
        part = _by_lang(ranked, settled, n_langs, "left_semi")
        done = part if done is None else done.unionByName(part)
        open_langs, goal = scratch.save(bounds.select("lang").join(settled, "lang", "left_anti"), "open"), 4 * goal
    if done is None:
        done = spark.createDataFrame([], "lang string, phrase binary, n long, l long, r long, score long, b long, rank int")
    out = _by_lang(done, total, n_langs)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
