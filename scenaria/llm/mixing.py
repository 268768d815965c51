"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised. The exponent is found by
bisection: the smallest on a grid of 2**-20 whose weights have at most the target entropy (a fraction
of the entropy of even weights) and repeat no source more than ``max_epochs`` times as often as the
least repeated one. Without a budget, the least repeated source is used exactly once, so that no
document is left out; with one, sources are cut or repeated to meet it.

The weights are realised as block permutations: a source's documents hash into blocks; each epoch
takes the blocks in a permutation of its own; the last epoch stops where the source's budget ends.
``mix_position`` orders all sources together at their weights.

Defined results: a null source is a source of its own; null or empty texts have no tokens and stay in
every full epoch; a source without tokens has weight 0 and is used once; repeated rows are mixed one by
one; other columns are passed on, but for those named like the result's own (in any case), which these
replace; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
GRID = 1 << 20
N_BLOCKS = 256
#: Bisection levels that one aggregate over the source table decides.
LEVELS = 4
#: A block of more rows is put in order in parts, by leading hex digits of the row digest.
PART_ROWS = 50_000
#: Columns that are worked out here, by name.
OWN = (
    "_src", "_tokens", "_digest", "_block", "_part", "_inside", "_before", "_upto",
    "src_tokens", "weight", "quota", "full", "epoch", "block_start", "alpha", "mix_position",
)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def with_blocks(docs: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Adds source key, token count, row digest and block."""
    digest = F.md5(F.concat(_text(F.col("doc_id")), F.lit("|"), _text(F.col("text"))).cast("binary"))
    return docs.withColumns(
        {
            "_src": F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))),
            "_tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "_digest": digest,
            "_block": (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_blocks).cast("int"),
        }
    )


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("_src", "_block").agg(F.sum("_tokens").alias("block_tokens"), F.count(F.lit(1)).alias("block_rows"))


def part_digits(sizes: DataFrame) -> int:
    """Hex digits of the digest that cut the largest block into parts of about PART_ROWS rows at most."""
    most, digits = sizes.agg(F.max("block_rows").alias("n")).first().n or 0, 0
    while most > PART_ROWS << 4 * digits and digits < 24:
        digits += 1
    return digits


def find_exponent(sizes: DataFrame, target_entropy: float, max_epochs: float) -> tuple[float, dict]:
    """The exponent by bisection, and the totals it rests on. One row comes to the driver per step."""
    sources = sizes.groupBy("_src").agg(F.sum("block_tokens").alias("t")).filter("t > 0")
    head = sources.agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.min("t").alias("least"), F.max("t").alias("most")
    ).first()
    if not head.n:
        return 1.0, {"total": 0, "z": 1.0, "most": 0}
    share = F.col("t") / F.lit(float(head.total))

    def moments(ks: list[int]):
        cols = []
        for i, k in enumerate(ks):
            power = F.pow(share, F.lit(k / GRID))
            cols += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}")]
        row = sources.agg(*cols).first()
        return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(ks))]

    def enough(k: int, z: float, ln: float) -> bool:
        a = k / GRID
        entropy = math.log(z) - a * ln / z
        repeats = (head.most / head.least) ** (1 - a)
        return entropy <= target_entropy * math.log(max(head.n, 2)) and repeats <= max_epochs

    low, high = -1, GRID  # the exponent is above low and at most high
    while high - low > 1:
        ks, ends = set(), [(low, high)]
        for _ in range(LEVELS):
            mids = [(a, (a + b) // 2, b) for a, b in ends if b - a > 1]
            ks |= {m for _, m, _ in mids}
            ends = [x for a, m, b in mids for x in ((a, m), (m, b))]
        order = sorted(ks)
        ok = {k: enough(k, *zl) for k, zl in zip(order, moments(order), strict=True)}
        for _ in range(LEVELS):
            if high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if ok[mid] else (mid, high)
    return high / GRID, {"total": head.total, "z": moments([high])[0][0], "most": head.most}


def mix(
    docs: DataFrame,
    scratch: Scratch,
    target_entropy: float = 0.95,
    max_epochs: float = 2.0,
    budget_tokens: int | None = None,
    n_blocks: int = N_BLOCKS,
) -> DataFrame:
    """The mixture: the documents' rows, once per epoch they are used in, with their place in the mixture."""
    blocks = with_blocks(docs.drop(*[c for c in docs.columns if c.lower() in OWN]), n_blocks)
    sizes = scratch.save(block_sizes(blocks), "block-sizes")
    digits = part_digits(sizes)
    blocks = blocks.withColumn("_part", F.substring("_digest", 1, digits))
    alpha, found = find_exponent(sizes, target_entropy, max_epochs)
    total = float(found["total"] or 1)
    weight = F.when(F.col("src_tokens") > 0, F.pow(F.col("src_tokens") / F.lit(total), F.lit(alpha)) / F.lit(found["z"])).otherwise(0.0)
    # The least repeated source is the largest: its tokens over its weight is the budget that uses all once.
    least = found["most"] / ((found["most"] / total) ** alpha / found["z"]) if found["most"] else 0.0
    budget = float(budget_tokens) if budget_tokens is not None else least
    quota = F.round(F.lit(budget) * F.col("weight")).cast("long")
    if budget_tokens is None:
        quota = F.greatest(quota, F.col("src_tokens"))
    by_source = Window.partitionBy("_src")
    per_block = sizes.withColumn("src_tokens", F.sum("block_tokens").over(by_source)).withColumn("weight", weight)
    per_block = per_block.withColumn("quota", quota).withColumn(
        "full", F.when(F.col("src_tokens") > 0, F.floor(F.col("quota") / F.col("src_tokens"))).otherwise(1).cast("int")
    )
    last = F.when(F.col("quota") > F.col("full") * F.col("src_tokens"), F.col("full")).otherwise(F.col("full") - 1)
    per_block = per_block.withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))
    permuted = Window.partitionBy("_src", "epoch").orderBy(
        F.md5(F.concat_ws("|", "_src", "epoch", "_block").cast("binary")), "_block"
    )
    per_block = per_block.withColumn(
        "block_start",
        F.col("epoch") * F.col("src_tokens") + F.sum("block_tokens").over(permuted) - F.col("block_tokens"),
    )
    per_block = per_block.drop("block_tokens", "block_rows")
    if digits:  # prefix sums in two levels: over a block's parts, and inside each part
        parts = blocks.groupBy("_src", "_block", "_part").agg(F.sum("_tokens").alias("_inside"))
        before = F.sum("_inside").over(Window.partitionBy("_src", "_block").orderBy("_part")) - F.col("_inside")
        parts = scratch.save(parts.withColumn("_before", before).drop("_inside"), "parts")
        per_block = per_block.join(parts, ["_src", "_block"])
    else:
        per_block = per_block.withColumns({"_part": F.lit(""), "_before": F.lit(0)})
    of_part = ["_src", "_block", "_part"]
    inside = Window.partitionBy(*of_part).orderBy("_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("_inside", F.sum("_tokens").over(inside)).join(per_block, of_part)
    placed = placed.withColumn("_upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside")
    end = F.col("block_start") + F.col("_upto")
    kept = placed.filter((F.col("epoch") < F.col("full")) | (end <= F.col("quota")))
    position = F.when(F.col("quota") > 0, (end - F.col("_tokens") / 2) / F.col("quota")).otherwise(0.0)
    return kept.withColumns({"alpha": F.lit(alpha), "mix_position": position})
