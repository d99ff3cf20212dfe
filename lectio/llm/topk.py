"""Exact top-k by multi-resolution segment statistics.

Vectors are cut into 1, 2, 4, ... equal segments (filled up with zeros to a power of two). At a level with
segments of m numbers the inner product is at most the sum over segments of m * mean * mean', plus the
product of what the means leave, sqrt(m) * deviation of the segments, by Cauchy and Schwarz (so |x|^2 + |y|^2
minus twice that bounds the squared distance from below); deviations are pooled in at most `POOLED`
groups of neighbouring segments. Levels are tried coarse to fine. The means of a level differ from
those of the level before by Haar details alone, so a level adds its details' products to the sums so
far instead of starting anew, and all levels together cost one inner product, beside the deviations.
After each level the candidates that no query of a small batch can use any more are left out, and
once few pairs are left these are carried on singly; a level that leaves nearly all pairs possible is
tried again now and then only. What survives gets its exact integer score. A
query's limit is its k-th best exact score so far, first over a bounded sample of candidates, and
goes on from block to block.

Rows are packed into blocks once, in the narrowest numbers that hold them. Every band of queries meets
every span of blocks in one task, which holds its queries and one block at a time and returns at most
k rows a query; the best k of these are taken by rank. No side is broadcast. The pairs grow with
queries x candidates, which exactness needs where bounds don't prune; the blocks that move grow with
queries / `BAND` x candidates.

Defined cases: a null vector, or one with components that are null or, scaled, not finite, or a null vec_id takes no
part, as query or candidate; vectors of another width than the query's are no candidates for it; a
query's own row is left out, but rows that repeat its vec_id with it; equal scores go to the smaller
vec_id; fewer candidates than k give fewer rows; an empty table gives an empty result; further columns are
ignored. Scores are exact whatever the components; one beyond the range of a long is ranked as it is and
returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage

K, SCALE = 5, 256
#: Candidates of a block, queries of a band and blocks of a span.
BLOCK, BAND, SPAN = 4096, 8192, 16
#: Queries that share their candidates, groups of deviations, and candidates whose exact scores set the first limits.
BATCH, POOLED, SEED = 128, 4, 256
#: Share of live candidates below which a batch leaves the others out, and of live pairs below which pairs are carried singly.
SPARSE, SINGLE = 0.8, 1 / 24
#: Share of pairs left possible above which a level is passed over, and batches after which it is tried again.
USELESS, AGAIN = 0.9, 32
_LONG = 1 << 63


class Levels:
    """Haar coefficients of rows, coarse to fine, and for each level the pooled deviations that are left."""

    def __init__(self, x: np.ndarray):
        n, width = len(x), 1 << max(0, int(x.shape[1] - 1).bit_length())
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        fine = []
        while x.shape[1] > 1:
            fine.append((x[:, ::2] - x[:, 1::2]) * np.sqrt(0.5))
            x = (x[:, ::2] + x[:, 1::2]) * np.sqrt(0.5)
        details = [x, *fine[::-1]]  # 1, 1, 2, 4, ... numbers: sums over the first are those of 1, 2, 4, ... segments' means
        self.all = np.concatenate(details, axis=1)
        self.ends = np.cumsum([d.shape[1] for d in details]).tolist()
        squares, left = np.zeros((n, width)), [np.zeros((n, 1))]
        for d in details[:0:-1]:  # a segment's squared deviation: its own detail and those of its halves
            squares = d * d + squares.reshape(n, d.shape[1], 2).sum(axis=2)
            left.append(np.sqrt(squares.reshape(n, min(d.shape[1], POOLED), -1).sum(axis=2)))
        self.left = left[::-1]

    def take(self, rows) -> Levels:
        out = object.__new__(Levels)
        out.all, out.ends, out.left = self.all[rows], self.ends, [d[rows] for d in self.left]
        return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows: doubles hold them below 2^53, else Python integers do."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    left, right = ([[int(a) for a in r] for r in rows.tolist()] for rows in (q, c))
    out = np.empty((len(q), len(c)), object)
    for i, x in enumerate(left):
        out[i] = [sum(a * b for a, b in zip(x, y, strict=True)) for y in right]
    return out


class Best:
    """The best k (score, vec_id, row) of each query so far."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, k: int):
        with np.errstate(over="ignore"):
            self.q, self.rows, self.k = q, rows, k
            self.levels, self.size = Levels(q), np.sqrt((q * q).sum(axis=1))
        self.found: list[list[tuple]] = [[] for _ in range(len(q))]
        self.limit = np.full(len(q), -np.inf)
        self.work = 0  # multiply-adds
        self.share, self.batches = [0.0] * len(self.levels.ends), 0

    def _offer(self, i: int, score: list, ids: list, rows: list) -> None:
        kept = self.found[i]
        known = {r for _, _, r in kept}
        kept += [(-s, v, r) for s, v, r in zip(score, ids, rows, strict=True) if r not in known and r != self.rows[i]]
        kept.sort()
        del kept[self.k :]
        if len(kept) == self.k:
            self.limit[i] = float(-kept[-1][0])

    def meet(self, c: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes in a block of candidates."""
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((c * c).sum(axis=1))
            slack = 1e-9 * self.size * size.max(initial=0) + 1e-6  # more than the rounding of the bounds
            if not np.isfinite(slack).all() or float(np.abs(c).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * c.shape[1] >= 2**53:
                return self._all(c, ids, rows)
        levels = Levels(c)
        if np.isneginf(self.limit).any():
            seed = np.linspace(0, len(c) - 1, min(SEED, len(c))).astype(int)
            first = exact(self.q, c[seed])
            self.work += first.size * c.shape[1]
            for i in np.flatnonzero(np.isneginf(self.limit)):
                top = np.argsort(-first[i], kind="stable")[: self.k + 1]  # its own row may be among them
                if len(seed) > self.k + 1:
                    self._offer(i, first[i, top].tolist(), ids[seed[top]].tolist(), rows[seed[top]].tolist())
        for at in range(0, len(self.q), BATCH):
            part = np.arange(at, min(at + BATCH, len(self.q)))
            for i, hit in self._survivors(part, levels, slack[part], len(c)):
                score = exact(self.q[i : i + 1], c[hit])[0]
                self.work += len(hit) * c.shape[1]
                good = score >= self.limit[i]
                self._offer(i, score[good].tolist(), ids[hit[good]].tolist(), rows[hit[good]].tolist())

    def _all(self, c: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Numbers too large for the bounds: every score, a few candidates at a time."""
        for at in range(0, len(c), 256):
            score = exact(self.q, c[at : at + 256])
            self.work += score.size * c.shape[1]
            for i in range(len(self.q)):
                self._offer(i, score[i].tolist(), ids[at : at + 256].tolist(), rows[at : at + 256].tolist())

    def _survivors(self, part: np.ndarray, levels: Levels, slack: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Queries of a batch, each with the candidates that every level leaves possible.

        A level that left most pairs possible is passed over, but for every `AGAIN`-th batch; its products
        are made with those of the next one.
        """
        mine, limit = self.levels.take(part), self.limit[part]
        columns, sums, other, pairs = np.arange(n), np.zeros((len(part), n)), levels, None
        last, done = len(levels.ends) - 1, 0
        for k, end in enumerate(levels.ends):
            if k < last and self.share[k] > USELESS and self.batches % AGAIN:
                continue
            cols, width = slice(done, end), end - done + mine.left[k].shape[1]
            done = end
            if pairs is None:
                sums += mine.all[:, cols] @ other.all[:, cols].T
                self.work += sums.size * width
                alive = sums + mine.left[k] @ other.left[k].T >= (limit - slack)[:, None]
                self.share[k] = alive.mean() if alive.size else 0
                if self.share[k] < SINGLE or k == last:
                    i, j = np.nonzero(alive)
                    pairs, sums = (i, columns[j]), sums[i, j]
                elif (live := alive.any(axis=0)).mean() < SPARSE:
                    columns, sums = columns[live], sums[:, live]
                    other = levels.take(columns)
            else:
                i, j = pairs
                sums = sums + np.einsum("pd,pd->p", mine.all[i, cols], levels.all[j, cols])
                self.work += len(i) * width
                good = sums + np.einsum("pd,pd->p", mine.left[k][i], levels.left[k][j]) >= (limit - slack)[i]
                pairs, sums = (i[good], j[good]), sums[good]
        self.batches += 1
        i, j = pairs
        ends = np.searchsorted(i, np.arange(len(part) + 1))
        for a, (b, e) in enumerate(zip(ends, ends[1:], strict=False)):
            own, hit = sums[b:e], j[b:e]
            if len(own) > 4 * self.k:  # no exact score for those that others surely beat (one may be the query itself)
                hit = hit[own >= np.partition(own, -self.k - 1)[-self.k - 1] - 2 * slack[a]]
            if len(hit):
                yield int(part[a]), hit


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """Integers (as doubles) in the narrowest numbers that hold them."""
    most = float(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _blocks(scale: int, block: int):
    """Rows to blocks of one width: candidates (side 1), and the queries among them once more (side 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["side", "width", "ids", "rows", "kind", "body"]
        held: dict[tuple[int, int], list] = {}
        row = TaskContext.get().partitionId() << 33

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            ids, rows, x = zip(*held.pop(key), strict=True)
            kind, body = pack(np.floor(np.array(x, np.float64).reshape(len(ids), key[1]) * scale))
            cols = [[key[0]], [key[1]], [np.array(ids, "<i8").tobytes()], [np.array(rows, "<i8").tobytes()], [kind], [body]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t) for c, t in zip(
                        cols, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()], strict=True
                    )
                ],
                names,
            )

        for b in batches:
            for i, q, v in zip(b.column("vec_id").to_pylist(), b.column("_q").to_pylist(), b.column("_v").to_pylist(), strict=True):
                for side in (1, 0) if q else (1,):
                    key = (side, len(v))
                    held.setdefault(key, []).append((i, row, v))
                    if len(held[key]) == block:
                        yield out(key)
                row += 1
        for key in list(held):
            yield out(key)

    return run


def _matrix(kind: str, body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, kind).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))


def _search(k: int):
    """A band's queries against a span's blocks; blocks come sorted by band, span, width and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_query", "query_id", "vec_id", "_row", "score", "_near"]
        now, queries, best = None, [], None

        def answer() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _, _ in queries]).tolist()
            rows = [
                (
                    int(best.rows[i]), ids[i], v, r, max(-_LONG, min(_LONG - 1, -s)), float(-s)
                ) for i, found in enumerate(best.found) for s, v, r in found
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if n != "_near" else pa.float64()) for c, n in zip(cols, names, strict=True)],
                names,
            )

        for b in batches:
            for r in b.to_pylist():
                key = (r["_band"], r["_span"], r["width"])
                if key != now:
                    if best is not None:
                        yield answer()
                    now, queries, best = key, [], None
                ids, rows, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8"), _matrix(r["kind"], r["body"], r["width"])
                if not r["width"]:
                    x = np.zeros((len(ids), 1))  # vectors without components: every score is 0
                if r["side"] == 0:
                    queries.append((ids, rows, x))
                elif queries:
                    if best is None:
                        best = Best(np.concatenate([x for *_, x in queries]), np.concatenate([n for _, n, _ in queries]), k)
                    best.meet(x, ids, rows)
        if best is not None:
            yield answer()

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    band: int = BAND,
    span: int = SPAN,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates.

    is_query: a condition on the column vec_id.
    """
    v = F.col("_v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")
    ).where(F.col("vec_id").isNotNull() & F.coalesce(v.isNotNull() & sound, F.lit(False)))
    rows = rows.select("vec_id", "_v", F.coalesce(is_query, F.lit(False)).alias("_q"))
    blocks = rows.mapInArrow(_blocks(scale, block), "side int, width int, ids binary, rows binary, kind string, body binary")
    blocks = stage(blocks.withColumn("name", F.monotonically_increasing_id()), "vector-blocks")
    held = {r[0]: (r[1], r[2]) for r in blocks.groupBy("side").agg(F.sum(F.length("ids") / 8).cast("long"), F.count("*")).collect()}
    queries, (n, pieces) = held.get(0, (0, 0))[0], held.get(1, (0, 0))
    bands = max(1, -(-queries // band))
    # spans are as long as memory allows, but enough of them for all cores
    spans = max(1, -(-n // (block * span)), min(pieces, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // bands)))
    deal = lambda m: F.pmod(F.xxhash64("name"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cols = ["_band", "_span", "width", "side", "name", "ids", "rows", "kind", "body"]
    as_q = blocks.where("side = 0").withColumn("_band", deal(bands)).withColumn("_span", every(spans))
    as_c = blocks.where("side = 1").withColumn("_span", deal(spans)).withColumn("_band", every(bands))
    met = as_q.select(cols).unionByName(as_c.select(cols)).repartition(bands * spans, "_band", "_span").sortWithinPartitions(
        "_band", "_span", "width", "side", "name"
    )
    near = met.mapInArrow(_search(k), "_query long, query_id long, vec_id long, _row long, score long, _near double")
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.desc("_near"), "vec_id", "_row"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
