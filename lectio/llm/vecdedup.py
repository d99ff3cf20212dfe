"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Every vector is scaled to unit length and quantised to int8 with its own step; the length of its
quantisation error is stored beside it (rounded up). For unit vectors x, y with quantised forms
x', y' and errors e: |x.y - x'.y'| <= |ex| |y| + |x'| |ey| <= |ex| + (1 + |ex|) |ey|. A tile
multiplies int8 codes (as floats that hold all sums exactly) and recomputes in double precision
only the pairs whose product plus bound reaches the threshold. Equal vectors are one class before
any product, so copies cost nothing. Classes are dealt to cells by their nearest pivot (about the
square root of the number of blocks); two cells are compared unless the angles to the pivots prove
(triangle inequality) that no pair can reach the threshold. A cell's vectors are packed into blocks
once, in single precision where that holds them exactly; a tile gets two whole blocks and
returns link sums per class and a spanning forest of its links, never pairs.

Defined cases: vectors that are null, zero or hold a null or non-finite component link with nothing
(n_links 0, their own component); vectors of different widths never link; repeated rows are
copies of one another and link; an empty table gives an empty result; further columns are ignored.
Rows with one vec_id count as separate vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, read_table, stage, unstage
from .graph import components
from .tiles import each_group, forest

THRESHOLD = 0.95
#: Classes of a block of a cell; a tile holds two blocks. Small tables are cut into `FEW` blocks at least.
BLOCK, FEW = 16_384, 4
#: Added to every bound for the rounding of the bound itself.
SLACK = 1e-6


def usable(vector: str):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, safe for tiny and huge components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, steps and error lengths (upper bounds) of unit rows."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.rint(x / step[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, step, error


def close_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with x[i].y[j] >= threshold, block by block of x; without y pairs i < j of x itself."""
    cx, sx, ex = quantise(x)
    other, (cy, sy, ey) = (x, (cx, sx, ex)) if y is None else (y, quantise(y))
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fy = np.ascontiguousarray(cy.T).astype(kind)
    for at in range(0, len(x), rows):
        part, begin = slice(at, at + rows), at if y is None else 0
        near = cx[part].astype(kind) @ fy[:, begin:]
        near *= sx[part, None].astype(kind)
        near *= sy[begin:].astype(kind)
        near += (ex[part] + 2 * SLACK)[:, None].astype(kind) + (1 + ex[part])[:, None].astype(kind) * ey[begin:].astype(kind)
        i, j = np.nonzero(near >= threshold)
        i, j = i + at, j + begin
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 200_000):  # full precision for the few that the bound lets through
            a, b = i[k : k + 200_000], j[k : k + 200_000]
            good = (x[a] * other[b]).sum(axis=1) >= threshold
            yield a[good], b[good]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its classes' names, copies and vectors."""
    for t in each_group(batches, ["width", "cell", "s"]):
        x = _matrix(t.column("e"), t.column("width")[0].as_py())
        with np.errstate(over="ignore"):
            single = x.astype("<f4")
        body = single if (single.astype(np.float64) == x).all() else x.astype("<f8")
        own = [[t.column(c)[0].as_py()] for c in ("width", "cell", "s")]
        held = [[t.column(c).to_numpy().astype("<i8").tobytes()] for c in ("node", "copies")]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(v, pa.int32()) for v in own],
                *[pa.array(v, pa.binary()) for v in held],
                pa.array([body.tobytes()], pa.binary()),
            ],
            ["width", "cell", "s", "nodes", "copies", "body"],
        )


def _tile(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n: pa.nulls(n, pa.int64())
        for t in each_group(batches, ["_tile"]):
            blocks = []
            if t.num_rows == 1 and not t.column("_same")[0].as_py():
                continue  # no class is in the other block
            for r in t.to_pylist():
                node = np.frombuffer(r["nodes"], "<i8")
                x = np.frombuffer(r["body"], "<f4" if len(r["body"]) == 4 * len(node) * r["width"] else "<f8").astype(np.float64)
                blocks.append((node, np.frombuffer(r["copies"], "<i8"), unit(x.reshape(len(node), -1))))
            node, copies = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
            shift = len(blocks[0][0]) if len(blocks) > 1 else 0
            links = np.zeros(len(node), np.int64)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in close_pairs(blocks[0][2], blocks[1][2] if shift else None, threshold):
                b = b + shift
                links += np.bincount(a, copies[b], len(links)).astype(np.int64) + np.bincount(b, copies[a], len(links)).astype(np.int64)
                pairs.append(_forest_of(a, b, len(node)))
            got = np.flatnonzero(links)
            a, b = (np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)]) for k in (0, 1))
            a, b = _forest_of(a, b, len(node))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[got]), pa.array(links[got]), none(len(got)), none(len(got))], ["node", "links", "a", "b"]
            )
            yield pa.RecordBatch.from_arrays(
                [none(len(a)), none(len(a)), pa.array(node[a]), pa.array(node[b])], ["node", "links", "a", "b"]
            )

    return run


def _forest_of(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins what the pairs join, by repeated least labels."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    out = np.flatnonzero(label != np.arange(n))
    return out, label[out]


def dedup_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    pivots: int | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`."""
    spark = vectors.sparkSession
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("e"))
    # -0.0 and 0.0 are one number; the two hashes are a class's name
    clean = F.transform("e", lambda x: x.cast("double") + F.lit(0.0))
    rows = read.select("vec_id", F.when(usable("e"), clean).alias("e"))
    named = rows.select("vec_id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(1), "e").alias("h2"))
    classes = named.where(F.col("e").isNotNull()).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("e").alias("e")
    )
    classes = stage(
        classes.select(
            "h1", "h2", "rep", "copies", "e", F.size("e").alias("width"), F.monotonically_increasing_id().alias("node")
        ),
        "vector-classes",
    )

    total = classes.count()
    block = max(1, min(block, -(-total // FEW)))
    want = pivots or max(1, isqrt(total // block))
    centres: dict[int, np.ndarray] = {}
    for r in classes.orderBy("h1", "h2").limit(want).select("width", "e").collect():  # names are hashes: a fair sample
        centres.setdefault(r[0], []).append(r[1])
    centres = {w: unit(np.array(v)) for w, v in centres.items()}

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column("width").to_numpy(zero_copy_only=False)
            cell, angle = np.full(len(width), -1, np.int32), np.full(len(width), np.pi)
            for w in set(width.tolist()) & set(centres):
                at = np.flatnonzero(width == w)
                cos = unit(_matrix(pa.chunked_array([b.column("e").take(pa.array(at))]), w)) @ centres[w].T
                cell[at] = cos.argmax(axis=1)
                angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("node", "copies", "e", "width", "h1")), pa.array(cell), pa.array(angle)],
                ["node", "copies", "e", "width", "h1", "cell", "angle"],
            )

    cells = classes.mapInArrow(to_cells, "node long, copies long, e array<double>, width int, h1 long, cell int, angle double")
    cells = stage(cells, "vector-cells")
    sizes = cells.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()  # widths x pivots rows
    reach = np.arccos(threshold) + 1e-9
    plan = []
    for p in sizes:
        for q in sizes:
            if p["width"] != q["width"] or p["cell"] > q["cell"]:
                continue
            apart = 0.0
            if p["cell"] != q["cell"] and p["cell"] >= 0:
                c = centres[p["width"]]
                apart = np.arccos(np.clip(c[p["cell"]] @ c[q["cell"]], -1, 1)) - p["far"] - q["far"]
            if apart <= reach:
                np_, nq = -(-p["n"] // block), -(-q["n"] // block)
                plan.append((p["width"], p["cell"], q["cell"], np_, nq))
    table = spark.createDataFrame(plan, "width int, c int, d int, nc int, nd int")  # about one row per block, if nothing is pruned
    counts = spark.createDataFrame([(r["width"], r["cell"], -(-r["n"] // block)) for r in sizes], "width int, cell int, blocks int")
    blocks = cells.join(counts, ["width", "cell"]).withColumn("s", F.pmod(F.col("h1"), F.col("blocks").cast("long")).cast("int"))
    blocks = blocks.repartition("width", "cell", "s").sortWithinPartitions("width", "cell", "s", "node")
    blocks = stage(blocks.mapInArrow(_pack, "width int, cell int, s int, nodes binary, copies binary, body binary"), "vector-blocks")

    # each block goes to every tile of its own; a tile is named by its cells and blocks
    tile = F.concat_ws(",", "width", "c", "d", "s", "t").alias("_tile")
    cols = [tile, "_side", ((F.col("c") == F.col("d")) & (F.col("s") == F.col("t"))).alias("_same"), "width", "nodes", "copies", "body"]
    as_c = blocks.withColumnRenamed("cell", "c").join(table, ["width", "c"]).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))
    ).where("c <> d or s <= t")
    as_d = blocks.withColumnRenamed("cell", "d").withColumnRenamed("s", "t").join(table, ["width", "d"]).withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))
    ).where("c <> d or s < t")
    tiles = as_c.withColumn("_side", F.lit(0)).select(*cols).unionByName(
        as_d.withColumn("_side", F.lit(1)).select(*cols)
    ).repartition("_tile").sortWithinPartitions("_tile", "_side")
    found = stage(tiles.mapInArrow(_tile(threshold), "node long, links long, a long, b long"), "vector-links")
    unstage(cells, blocks)

    links = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("a").isNotNull()).select("a", "b")).withColumnRenamed("component", "root")
    per_class = classes.select("h1", "h2", "rep", "copies", "node").join(links, "node", "left").join(joined, "node", "left")
    per_class = stage(
        per_class.select(
            "h1",
            "h2",
            "rep",
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        ),
        "vector-roots",
    )
    least = stage(per_class.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("_n")), "vector-components")
    answer = stage(
        join_by_size(per_class, least, ["root"], "_n", total).select("h1", "h2", "copies", "n_links", "component_id"),
        "vector-answers",
    )
    sound, rest = named.where(F.col("e").isNotNull()).select("vec_id", "h1", "h2"), named.where(F.col("e").isNull()).select("vec_id")
    done = join_by_size(sound, answer, ["h1", "h2"], "copies", vectors.count()).select("vec_id", "n_links", "component_id")
    done = done.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(read_table(spark, sf_dir, "embeddings"))


VECTOR_DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_inner_product(p.e, q.e) / (p.n * q.n) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
