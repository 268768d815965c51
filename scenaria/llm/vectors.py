"""Near-duplicate vectors, exactly: sorted projection passes first, then all classes against all others.

Equal vectors form one class, compared once. In each pass, the signs of random projections are
concatenated to a code; classes are ordered by their codes (range partitioning and a sort), and each is
compared with a bounded number of its neighbours in that order. Pairs whose cosine reaches the threshold
are united across all passes into components. The passes only spare edges: they settle nothing.

Then a chunk of classes of bounded size at a time goes to all tasks and is compared with all classes of
its own and later chunks, which counts every link and finds those between components that no pass met.
A tile of a chunk is left out for a vector only when the angle to the tile's centre exceeds the tile's
radius and the threshold's angle together, so no pair is lost. Work grows with the square of the number of
classes, less what the tiles spare. Cosines are decided in double precision; single precision only rules
out pairs that lie below the threshold by more than its largest error.

Defined results: a vector that is null, empty or zero, or that holds a null or non-finite component,
links with nothing (so does a row without vec_id); vectors of different lengths never link; rows that
repeat a vector are links of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .graph import components

PASSES = 6
NEIGHBOURS = 48
BITS = 63
#: Bytes of vectors that all tasks are given at once, and the vectors of a tile.
CHUNK_BYTES, TILE = 32 << 20, 256
SEED = 20_240_229


def classes(table: DataFrame) -> DataFrame:
    """(vec_id, vec as the bytes of its doubles, k): k is the class of equal vectors, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
                ok = i is not None and v and None not in v
                x = np.array(v, "<f8") + 0.0 if ok else None  # -0.0 becomes 0.0
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], ["vec_id", "vec"])

    kind = table.schema["vec_id"].dataType.simpleString()
    rows = table.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vec binary")
    return rows.withColumn("k", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))


def with_codes(vectors: DataFrame, passes: int = PASSES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Adds one code per pass: the signs of ``bits`` random projections, the first one weighing most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            codes = np.zeros((batch.num_rows, passes), np.int64)
            raws = batch["vec"].to_pylist()
            for dim in {len(r) for r in raws}:
                at = [i for i, r in enumerate(raws) if len(r) == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + dim).standard_normal((dim // 8, passes * bits))
                x = np.frombuffer(b"".join(raws[i] for i in at), "<f8").reshape(len(at), -1)
                signs = (x @ planes[dim] > 0).reshape(len(at), passes, bits)
                codes[at] = signs @ weights
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["vec"], *(pa.array(codes[:, p]) for p in range(passes))],
                ["k", "vec", *(f"code{p}" for p in range(passes))],
            )

    schema = "k long, vec binary, " + ", ".join(f"code{p} long" for p in range(passes))
    return vectors.select("k", "vec").mapInArrow(run, schema)


def _rows(raws: list[bytes]) -> np.ndarray:
    """Unit vectors of equal length, one per row."""
    x = np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_edges(ordered: DataFrame, threshold: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Verified pairs of classes at most ``neighbours`` places apart; per batch only those that unite groups."""

    def find(parent: list[int], i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def compare(ks: list[int], raws: list[bytes]) -> tuple[list[int], list[int]]:
        a, b = [], []
        for dim in {len(r) for r in raws}:
            at = [i for i, r in enumerate(raws) if len(r) == dim]
            x, parent = _rows([raws[i] for i in at]), list(range(len(at)))
            for gap in range(1, min(neighbours, len(at) - 1) + 1):
                near = np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= threshold
                for i in np.flatnonzero(near).tolist():
                    u, v = find(parent, i), find(parent, i + gap)
                    if u != v:
                        parent[u] = v
                        a.append(ks[at[i]]), b.append(ks[at[i + gap]])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, raws = [], []
        for batch in batches:
            ks, raws = ks + batch["k"].to_pylist(), raws + batch["vec"].to_pylist()
            a, b = compare(ks, raws)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            ks, raws = ks[-neighbours:], raws[-neighbours:]

    return ordered.mapInArrow(run, "a long, b long")


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``threshold`` or more."""
    slack = (x.shape[1] + 4) * 2.0**-22  # more than twice the largest error of single precision
    maybe = x.astype(np.float32) @ y.astype(np.float32).T >= threshold - slack
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if len(rows):
        maybe[np.ix_(rows, cols)] = x[rows] @ y[cols].T >= threshold
    return maybe


def tiles(x: np.ndarray, threshold: float, size: int = TILE) -> list[tuple[int, int, np.ndarray, float]]:
    """(begin, end, centre, reach): a vector with a cosine under reach to the centre is near none of the tile's."""
    out = []
    for begin in range(0, len(x), size):
        part = x[begin : begin + size]
        centre = part.sum(axis=0)
        length = np.sqrt(centre @ centre)
        if length < 1e-9:
            out.append((begin, begin + size, centre, -1.0))
            continue
        centre /= length
        angle = np.arccos(np.clip((part @ centre).min(), -1, 1)) + np.arccos(np.clip(threshold, -1, 1)) + 1e-6
        out.append((begin, begin + size, centre, float(np.cos(angle)) if angle < np.pi else -2.0))
    return out


def chunk_links(left: DataFrame, chunk: pa.Table, number: int, threshold: float) -> DataFrame:
    """The links between a chunk's classes and all of ``left`` (k, vec, copies, component, chunk).

    Rows (k, null, links): rows of other classes linked with k; rows (a, b, 0): linked components, per task
    only those that unite groups. Pairs inside the chunk meet twice and count one way each time.
    """
    raws = chunk["vec"].to_pylist()
    sides = {}
    for dim in {len(r) for r in raws}:
        at = [i for i, r in enumerate(raws) if len(r) == dim]
        x = _rows([raws[i] for i in at])
        sides[dim] = (*(chunk[c].to_numpy()[at] for c in ("k", "copies", "component")), x, tiles(x, threshold))
    shared = left.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = shared.value
        total = {dim: np.zeros(len(side[0]), np.int64) for dim, side in by_dim.items()}
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def counted(k: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(k[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], ["k", "b", "links"])

        for batch in batches:
            raws, edges = batch["vec"].to_pylist(), []
            for dim in {len(r) for r in raws} & by_dim.keys():
                at = [i for i, r in enumerate(raws) if len(r) == dim]
                k, copies, label, where = (batch[c].to_numpy()[at] for c in ("k", "copies", "component", "chunk"))
                x, links = _rows([raws[i] for i in at]), np.zeros(len(at), np.int64)
                back = np.where(where == number, 0, copies)
                other_k, other_copies, other_label, y, parts = by_dim[dim]
                for begin, end, centre, reach in parts:
                    some = np.flatnonzero(x @ centre >= reach)
                    if not len(some):
                        continue
                    near = _near(x[some], y[begin:end], threshold)
                    near &= k[some, None] != other_k[begin:end]
                    if not near.any():
                        continue
                    links[some] += near @ other_copies[begin:end]
                    total[dim][begin:end] += back[some] @ near
                    i, j = np.nonzero(near & (label[some, None] != other_label[begin:end]))
                    for a, b in np.unique(np.stack([label[some[i]], other_label[begin + j]], axis=1), axis=0).tolist():
                        u, v = find(a), find(b)
                        if u != v:
                            parent[u] = v
                            edges.append((a, b))
                yield counted(k, links)
            a, b = zip(*edges, strict=True) if edges else ((), ())
            cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "b", "links"])
        for dim, side in by_dim.items():
            yield counted(side[0], total[dim])

    return left.mapInArrow(run, "k long, b long, links long")


def all_links(labelled: DataFrame, threshold: float, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``chunk_links`` for all classes: ``labelled`` has k, vec, copies, component and code0."""
    size = labelled.agg(F.sum(F.octet_length("vec"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = labelled.withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(chunks)).cast("int"))
    dealt = scratch.save(dealt.repartition(shuffle_partitions(labelled.sparkSession), "k"), "labelled")
    found = None
    for c in range(chunks):
        # In an order that brings near vectors together, so that the tiles are small.
        chunk = dealt.filter(F.col("chunk") == c).orderBy("code0", "k").toArrow()
        links = chunk_links(dealt.filter(F.col("chunk") >= c), chunk, c, threshold)
        links = scratch.save(links, "links")
        found = links if found is None else found.unionByName(links)
    return found


def near_duplicates(
    table: DataFrame, scratch: Scratch, threshold: float = 0.95, passes: int = PASSES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per vector: n_links, component_id and whether it is the one kept of its component."""
    spark = table.sparkSession
    rows = scratch.save(classes(table), "rows")
    grouped = rows.filter("k IS NOT NULL").groupBy("k").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec")
    )
    grouped = scratch.save(grouped, "classes")
    coded = scratch.save(with_codes(grouped, passes), "codes")
    n, found = shuffle_partitions(spark), None
    for p in range(passes):
        ordered = coded.select("k", "vec", f"code{p}").repartitionByRange(n, f"code{p}", "k").sortWithinPartitions(f"code{p}", "k")
        edges = neighbour_edges(ordered.select("k", "vec"), threshold)
        found = edges if found is None else found.unionByName(edges)
    edges = scratch.save(found.distinct(), "pass-edges")
    united = scratch.save(components(edges, scratch).withColumnRenamed("vertex", "k"), "united")
    labelled = coded.select("k", "vec", "code0").join(grouped.select("k", "copies"), "k").join(united, "k", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "k"))
    compared = all_links(labelled, threshold, scratch, chunk_bytes)
    links = compared.filter("b IS NULL").groupBy("k").agg(F.sum("links").alias("links"))
    edges = edges.unionByName(compared.filter("b IS NOT NULL").select(F.col("k").alias("a"), "b"))
    united = scratch.save(components(edges, scratch).withColumnRenamed("vertex", "k"), "components")
    members = united.join(grouped, "k")
    ids = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = (
        grouped.select("k", "least_id", "copies")
        .join(united.join(ids, "component").select("k", "component_id"), "k", "left")
        .join(links, "k", "left")
        .select(
            "k",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        )
    )
    return (
        rows.select("vec_id", "k")
        .join(by_class, "k", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
