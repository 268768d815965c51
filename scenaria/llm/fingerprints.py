"""Document fingerprints by winnowing, in DataFrame expressions.

Words (maximal runs without white space) hash by crc32; a k-gram's hash is a rolling polynomial of its
words' hashes modulo a prime. Of every ``window`` consecutive grams the one with the smallest hash is
selected, the rightmost of equals, and kept with its position: two texts that share ``k + window - 1``
consecutive words share a selected gram. Likeness is the Jaccard similarity of the selected hashes.

Defined results: a null text is empty; a text without words has an empty fingerprint; one with fewer than
k words has a single gram of all of them; a text with fewer grams than a window has one window. Empty
fingerprints are like each other (1) and like nothing else (0). Repeated rows are fingerprinted one by one, and
follow each other in the order of ids; rows without an id come last. Columns other than doc_id and text are
left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

BLANKS = r"[\x20\x09-\x0D]+"
K = 4
WINDOW = 8
#: Prime below 2**33 and base of the rolling hash: products of a hash and the base squared fit 63 bits.
PRIME = (1 << 33) - 9
BASE = 32003
#: A selected gram is hash * 2**30 + (2**30 - 1 - position): the smallest value is the rightmost minimum.
POSITIONS = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and uses it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pairs(items: Column, gap: int, combine: Callable[[Column, Column], Column]) -> Column:
    """Each item combined with the one ``gap`` places on."""

    def body(x: Column) -> Column:
        n = F.greatest(F.size(x) - gap, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(gap + 1), n), combine)

    return let(items, body)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def gram_hashes(words: Column) -> Column:
    """Rolling hashes of all K-grams (K = 4: pairs, then pairs of pairs)."""
    ones = F.transform(words, lambda w: F.crc32(w.cast("binary")))
    twos = pairs(ones, 1, lambda a, b: (a * F.lit(BASE) + b) % F.lit(PRIME))
    return pairs(twos, 2, lambda a, b: (a * F.lit(BASE * BASE) + b) % F.lit(PRIME))


def select_minima(hashes: Column) -> Column:
    """Selected grams of a text's gram hashes, window 8 (doubled three times)."""
    valued = F.transform(hashes, lambda h, i: h * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i))

    def minima(values: Column) -> Column:
        windows = values
        for gap in (1, 2, 4):
            windows = pairs(windows, gap, lambda a, b: F.least(a, b))
        short = F.array(F.array_min(values))
        return F.when(F.size(values) == 0, F.slice(values, 1, 0)).when(F.size(values) < WINDOW, short).otherwise(F.array_distinct(windows))

    return let(valued, minima)


def selected(text: Column) -> Column:
    """The selected grams of a text, in the order of the windows."""

    def body(words: Column) -> Column:
        whole = F.crc32(F.array_join(words, " ").cast("binary")) % F.lit(PRIME)
        grams = F.when(F.size(words) == 0, F.array().cast("array<bigint>"))
        grams = grams.when(F.size(words) < K, F.array(whole)).otherwise(gram_hashes(words))
        return select_minima(grams)

    return let(words_of(text), body)


def hashes_of(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda v: F.shiftright(v, 30)))


def as_text(grams: Column) -> Column:
    """``hash:position`` of the selected grams."""
    show = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 30))), F.lit(":"), (F.lit(POSITIONS - 1) - v % POSITIONS).cast("string"))
    return F.array_join(F.transform(grams, show), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


#: Rows are ordered in buckets between quantiles of the id; about so many bytes of text to a bucket.
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 4096


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Adds ``next``: the text and derived columns of the row that follows by descending doc_id (after the last: the first).

    The derived columns are worked out once per row, after the texts have been dealt out to buckets.

    Equal ids are ordered by a hash of the text, null ids come last. A bucket holds the rows between two
    quantiles of the id (a value that fills several quantiles is split by that hash), so that no window
    runs over more than about one bucket's rows; the first rows of the buckets link them.
    """
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = int(min(MAX_BUCKETS, max(1, (size.b or 0) // BUCKET_BYTES, size.n // 1_000_000)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first().q if n > 1 else []
    quantiles = F.array(*[F.lit(q) for q in cuts or []])
    if cuts:
        below = F.size(F.filter(quantiles, lambda q: q < F.col("doc_id")))
        equal = F.size(F.filter(quantiles, lambda q: q == F.col("doc_id")))
        part = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * (equal + 1))
        bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(below + F.when(equal > 0, F.least(part, equal)).otherwise(0))
    else:
        bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    docs = docs.withColumn("_bucket", bucket.cast("int"))
    # The first row of each bucket, which follows the last row of the bucket before.
    rank = F.struct(F.col("doc_id").alias("i"), F.col("_tie").alias("t"))
    firsts = docs.groupBy("_bucket").agg(F.max(rank).alias("_first"))
    after = F.struct("text", *derived)
    heads = docs.join(
        F.broadcast(firsts),
        (docs["_bucket"] == firsts["_bucket"]) & docs["doc_id"].eqNullSafe(F.col("_first.i")) & (docs["_tie"] == F.col("_first.t")),
        "left_semi",
    ).dropDuplicates(["_bucket"]).withColumns(derived)
    order = Window.orderBy(F.desc("_bucket"))  # as many rows as buckets
    links = firsts.select("_bucket", F.coalesce(F.lead("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())).alias("_to"))
    heads = heads.select(F.col("_bucket").alias("_to"), after.alias("_head"))
    heads = links.join(heads, "_to").select("_bucket", "_head")
    down = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("_tie"))
    return (
        docs.repartition(max(n, shuffle_partitions(docs.sparkSession)), "_bucket")
        .withColumns(derived)
        .withColumn("_lead", F.lead(after).over(down))
        .join(heads, "_bucket")
        .withColumn("next", F.coalesce("_lead", "_head"))
        .drop("_lead", "_head", "_bucket", "_tie")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likenesses to the edited and the next one.

    The edited text has its last third replaced by as many code points from the start of the next document.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(base, {"grams": selected(F.col("text"))})
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next.text"), F.lit(1), tail)).alias("edited"),
        "grams",
        hashes_of(F.col("grams")).alias("own"),
        hashes_of(F.col("next.grams")).alias("next_hashes"),
    )
    rows = rows.withColumn("edited_grams", selected(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("grams")).alias("fingerprint"),
        as_text(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes_of(F.col("edited_grams"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )
