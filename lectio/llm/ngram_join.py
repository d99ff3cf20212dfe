"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each distinct text gets `TREES * LEVELS` MinHash values (Broder, 1997) of its set of `SHINGLE`-word
shingles. A tree's trie (Bawa, Condie and Ganesan, "LSH Forest", 2005) is the sorted order of its
`LEVELS` values; texts that share a prefix are one run of it. A pair at the threshold t shares a
prefix of d values with probability t^d, so a text that is matched at depth d[j] in tree j misses such
a partner with probability prod(1 - t^d[j]). Every text starts at full depth in all trees and its
prefixes are shortened, one value at a time and where the next run is smallest first, until that
product falls to 1 - `TARGET`: common prefixes stay long, rare ones, which cost nothing, become short.
No prefix has to be shorter than `depth()`, where every text reaches the target. A run is cut where
its most demanding member asks, so both texts of a pair are matched alike and no run is cut off or capped.

In a run pairs are compared by all their MinHash values and kept if the agreement could
still be that of a pair at the threshold (`AGREE` lies more than six standard deviations below);
only a spanning forest of those pairs leaves the run. Its components are candidate groups: in
each, all pairs of texts are verified exactly, by intersection of their whole shingle sets, so that
links are counted once and none between different texts is lost. Groups of any size are cut into
tiles of block pairs (tiles.py); of a group with several blocks only the differences to one base
set travel, which are short between near copies. Equal texts are one class throughout, and never paired.

Words are runs of word characters of the lower-cased text. A text with fewer words than a shingle
has one shingle, all its words. Links: Jaccard similarity of at least `THRESHOLD`.

Defined cases: a null or empty text, or one without words, links with nothing, equal ones included;
equal texts link with each other; whole texts are used; a null doc_id joins in, and counts as the
component's smallest only if all of its ids are null; an empty table gives an empty result; further
columns are ignored (or, by keep_one, kept unchanged).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, read_table, small, stage, texts, unstage
from .graph import components
from .tiles import each_group, forest, into_tiles

SHINGLE, THRESHOLD = 5, 0.8
TREES, LEVELS = 20, 6
TARGET = 0.9999
#: Least share of equal MinHash values of a candidate pair.
AGREE = 0.55
#: Texts of a block in the prefix groups, and texts and characters of a block in verification.
GROUP_BLOCK, VERIFY_BLOCK, VERIFY_CHARS = 1024, 384, 4_000_000
REMEMBERED = 100_000
_WORD = re.compile(r"\w+")


def depth(threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, target: float = TARGET) -> int:
    """The longest prefix whose groups hold a pair at the threshold with probability `target`."""
    for d in range(levels, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= target:
            return d
    return 1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf8", "surrogatepass"))
        return h


_hashes = _Hashes()
_MULTIPLY, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MULTIPLY
        out ^= out >> _SHIFT
    return np.unique(out)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000_603)
    return (
        rng.integers(0, 1 << 62, count, dtype=np.uint64) << np.uint64(1)
    ) | np.uint64(1), rng.integers(0, 1 << 62, count, dtype=np.uint64)


_A, _B = _coefficients(TREES * LEVELS)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """MinHash values by multiply-add-shift; their low 16 bits are kept."""
    x = shingle_set >> np.uint64(32)
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _A + _B).min(axis=0), out=least)
    return ((least >> np.uint64(30)) & np.uint64(0xFFFF)).astype("<u2")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        sets = (shingles(t) for t in texts(b.column("_text")))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("key"),
                b.column("rep"),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                b.column("chars"),
            ],
            ["key", "rep", "sig", "chars"],
        )


def _run_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the runs' candidate pairs."""
    for t in each_group(batches, ["run", "_t1", "_t2"]):
        node = t.column("node").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(node), -1)
        need = AGREE * sig.shape[1]

        def alike(rows: np.ndarray, sig=sig, need=need) -> np.ndarray:
            out = np.empty((len(rows), len(sig)), bool)
            for at in range(0, len(rows), 32):
                out[at : at + 32] = (sig[rows[at : at + 32], None] == sig).sum(axis=2) >= need
            return out

        edges = np.array(forest(alike, len(node)), np.int64).reshape(-1, 2)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], ["a", "b"])


def overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections: a product of 0/1 rows over the shingles that two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(column, minlength=len(value))
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        dense = np.zeros((n, columns), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return np.rint(out).astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of a tile: their weighted number by text, and a forest of them."""
    none = lambda n: pa.nulls(n, pa.int64())
    names = ["node", "links", "a", "b"]
    for t in each_group(batches, ["group", "_t1", "_t2"]):
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # a repeated row's set may have come twice
        if len(node) < 2:
            continue
        block, copies, base = (t.column(c).to_numpy()[first] for c in ("_block", "copies", "base_size"))
        more, less = ([np.frombuffer(column[int(i)].as_py(), np.uint64) for i in first] for column in (t.column("more"), t.column("less")))
        lacks = np.array(list(map(len, less)))
        both = base - lacks[:, None] - lacks + overlaps(less) + overlaps(more)
        size = np.diag(both)
        union = size[:, None] + size - both
        link = both >= THRESHOLD * union - 1e-9
        np.fill_diagonal(link, False)
        counted = link if t.column("_t1")[0].as_py() == t.column("_t2")[0].as_py() else link & (block[:, None] != block)
        links = counted @ copies
        got = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got], pa.int64()), none(len(got)), none(len(got))], names)
        edges = np.array(forest(lambda rows, link=link: link[rows], len(node)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [none(len(edges)), none(len(edges)), pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names
        )


def _prefix(depth_: int):
    return F.substring("trie", 1, 2 * depth_)


def choose_depths(
    sizes: list[list[int]], free: int, threshold: float = THRESHOLD, levels: int = LEVELS, target: float = TARGET
) -> list[int]:
    """Depths of a text's prefixes in its trees: sizes[j] are the sizes of its runs at depths
    levels, levels - 1, ... of tree j; in `free` more trees it is alone even at the last of them."""
    missed = [np.log1p(-(threshold ** (levels - k))) for k in range(len(sizes[0]) if sizes else 1)]
    last = len(missed) - 1
    at, now = [0] * len(sizes), free * np.log1p(-(threshold ** depth(threshold, levels=levels, target=target))) + len(sizes) * missed[0]
    heap = [(s[1], j) for j, s in enumerate(sizes) if last]
    heapify(heap)
    while now > np.log1p(-target) and heap:
        _, j = heappop(heap)
        now += missed[at[j] + 1] - missed[at[j]]
        at[j] += 1
        if at[j] < last:
            heappush(heap, (sizes[j][at[j] + 1], j))
    return [levels - k for k in at]


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, tree, trie, want = [], [], [], []
        for n, entries in zip(b.column("node").to_pylist(), b.column("trees").to_pylist(), strict=True):
            node += [n] * len(entries)
            tree += [e["tree"] for e in entries]
            trie += [e["trie"] for e in entries]
            want += choose_depths([e["sizes"] for e in entries], TREES - len(entries))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node, pa.int64()),
                pa.array(tree, pa.int32()),
                pa.array(trie, pa.binary()),
                pa.array(want, pa.int32()),
            ],
            ["node", "tree", "trie", "want"],
        )


def _matched(classes: DataFrame) -> DataFrame:
    """node, run: the runs of the forest's tries with more than one text, each cut at its own depth."""
    top = depth()
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.substring(F.col("sig"), t * (2 * LEVELS) + 1, F.lit(2 * LEVELS)).alias("trie")
        ),
    )
    trees = classes.where(F.col("sig").isNotNull()).select("node", F.explode(tries).alias("p")).select("node", "p.tree", "p.trie")
    run = lambda d: F.xxhash64("tree", F.lit(d), _prefix(d))
    # sizes of the shortest prefixes' runs, by count before anything else moves; then of the longer ones
    members = trees.select("*", run(top).alias("run"))
    members = members.join(members.groupBy("run").agg(F.count("*").alias(f"n{top}")).where(f"n{top} > 1"), "run").drop("run")
    members = stage(members, "forest-members")
    sized = members
    for d in range(top + 1, LEVELS + 1):
        sized = sized.withColumn("run", run(d)).join(
            members.groupBy(run(d).alias("run")).agg(F.count("*").alias(f"n{d}")), "run"
        ).drop("run")
    sizes = F.array(*[F.col(f"n{d}") for d in range(LEVELS, top - 1, -1)])
    trees_of = sized.groupBy("node").agg(F.collect_list(F.struct("tree", "trie", sizes.alias("sizes"))).alias("trees"))  # TREES entries at most
    wanted = stage(trees_of.mapInArrow(_choose, "node long, tree int, trie binary, want int"), "forest-depths")
    # the run of a prefix is cut at the first depth that one of its members asks for
    cut = wanted.withColumn("depth", F.lit(None).cast("int"))
    for d in range(top, LEVELS):
        asked = wanted.groupBy(run(d).alias("run")).agg(F.min("want").alias("least")).where(F.col("least") <= d)
        cut = cut.withColumn("run", run(d)).join(asked, "run", "left").withColumn(
            "depth", F.when(F.col("depth").isNull() & F.col("least").isNotNull(), d).otherwise(F.col("depth"))
        ).drop("run", "least")
    cut = cut.withColumn("depth", F.coalesce("depth", F.lit(LEVELS)))
    runs = stage(
        cut.select(
            "node", F.xxhash64("tree", "depth", F.substring(F.col("trie"), F.lit(1), 2 * F.col("depth"))).alias("run")
        ),
        "forest-runs",
    )
    unstage(members, wanted)
    return runs


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the candidate classes' texts, once for each class and task."""
    seen: set[int] = set()
    for b in small(batches):
        node = b.column("node").to_pylist()
        fresh = [i for i, n in enumerate(node) if not (n in seen or seen.add(n))]
        text = b.column("_text")
        sets = pa.array([shingles(text[i].as_py() or "").tobytes() for i in fresh], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(pa.array(fresh, pa.int64())) for c in ("group", "node", "copies", "blocks")), sets],
            ["group", "node", "copies", "blocks", "set"],
        )


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as what they add to and lack of their group's base set."""
    for b in small(batches):
        own, base = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("set", "base"))
        more = pa.array([np.setdiff1d(s, o, assume_unique=True).tobytes() for s, o in zip(own, base, strict=True)], pa.binary())
        less = pa.array([np.setdiff1d(o, s, assume_unique=True).tobytes() for s, o in zip(own, base, strict=True)], pa.binary())
        size = pa.array([len(o) for o in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("group", "node", "copies", "blocks")), more, less, size],
            ["group", "node", "copies", "blocks", "more", "less", "base_size"],
        )


def _tiles_of(sets: DataFrame) -> DataFrame:
    """Tiles of the candidate groups; each base is dealt out once for each block of its group."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    names = ["group", "node", "copies", "blocks", "more", "less", "base_size"]
    small = sets.where("blocks = 1").select(
        "group",
        "node",
        "copies",
        "blocks",
        F.col("set").alias("more"),
        F.lit(b"").alias("less"),
        F.lit(0).cast("long").alias("base_size"),
    )
    large = sets.where("blocks > 1").withColumn("_block", block)
    base = large.where(F.col("node") == F.col("group")).groupBy("group", "blocks").agg(F.max("set").alias("base"))
    base = base.select("group", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"))
    large = large.join(base, ["group", "_block"]).mapInArrow(
        _differences, "group long, node long, copies long, blocks int, more binary, less binary, base_size long"
    )
    tiles = into_tiles(small.select(*names).unionByName(large), F.col("blocks"), F.xxhash64("node")).drop("blocks")
    return tiles.repartition("group", "_t1", "_t2").sortWithinPartitions("group", "_t1", "_t2")


def ngram_jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_links (documents linked directly, copies included), component_id (the smallest
    doc_id that links reach, its own included), kept (whether that is its own and, of texts with
    that id, its text has the smallest digest), and `key`, the text's digest: one row per row of docs."""
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    ).select("doc_id", "_text", F.unhex(F.md5("_text")).alias("key"))
    rows = stage(
        named.select(
            "key", F.col("doc_id").alias("rep"), "_text", F.length("_text").cast("long").alias("chars")
        ).mapInArrow(_signatures, "key binary, rep long, sig binary, chars long"),
        "signatures",
    )
    classes = rows.groupBy("key").agg(
        F.min("rep").alias("rep"),
        F.count("*").alias("copies"),
        F.max("sig").alias("sig"),
        F.max("chars").alias("chars"),
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")

    runs = _matched(classes)
    sizes = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    members = runs.join(sizes, "run").join(classes.select("node", "sig"), "node")
    tiles = into_tiles(members, F.ceil(F.col("n") / GROUP_BLOCK), F.xxhash64("node"))
    tiles = tiles.select(
        "run", "_t1", "_t2", "node", "sig"
    ).repartition("run", "_t1", "_t2").sortWithinPartitions("run", "_t1", "_t2", "node")
    candidates = components(tiles.mapInArrow(_run_forest, "a long, b long"))

    # exact verification of all pairs in a candidate group
    found = stage(
        candidates.withColumnRenamed("component", "group").join(
            classes.select("node", "key", "rep", "copies", "chars"), "node"
        ),
        "candidates",
    )
    unstage(runs)
    total = rows.count()
    weight = found.groupBy("group").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / VERIFY_BLOCK), F.ceil(F.col("chars") / VERIFY_CHARS))
    weight = stage(weight.select("group", "n", blocks.cast("int").alias("blocks")), "group-sizes")
    found = join_by_size(found.drop("chars"), weight, ["group"], "n", total)
    # of a class's rows those with its smallest id alone meet it; the id is part of the join's key. The candidates
    # grow with the rows, so that they are shuffled at every size and never broadcast.
    rid = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("rid")
    bodies = named.select("key", "doc_id", "_text", rid("doc_id")).join(
        found.select("*", rid("rep")).hint("merge"), ["key", "rid"]
    ).where(F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = bodies.select("group", "node", "copies", "blocks", "_text").mapInArrow(
        _sets, "group long, node long, copies long, blocks int, set binary"
    )
    sets = stage(sets, "candidate-sets")
    verified = stage(_tiles_of(sets).mapInArrow(_verify, "node long, links long, a long, b long"), "verified")
    unstage(sets, weight)

    links = verified.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(verified.where(F.col("a").isNotNull()).select("a", "b"))
    linked = stage(linked.join(classes.select("node", "key", "rep"), "node"), "linked")
    # a component's smallest member by (id, text), null ids last, so that one text leads where ids repeat or lack
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("_m"), F.count("*").alias("n"))
    answer = join_by_size(linked, stage(least, "component-leads"), ["component"], "n", total).join(links, "node").select(
        "node", F.col("_m.rep").alias("component_id"), (F.col("key") == F.col("_m.key")).alias("_leads"), "links"
    )
    judged = classes.join(answer, "node", "left").select(
        "key",
        "copies",
        F.col("sig").isNull().alias("_bare"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
        F.coalesce("_leads", F.lit(True)).alias("_leads"),
    )
    whole = join_by_size(rows.select("key", F.col("rep").alias("doc_id")), stage(judged, "judged-classes"), ["key"], "copies", total)
    own = lambda bare, other: F.when(F.col("_bare"), bare).otherwise(other)
    out = whole.select(
        "doc_id",
        own(F.lit(0).cast("long"), F.col("n_links")).alias("n_links"),
        own(F.col("doc_id"), F.col("component_id")).alias("component_id"),
        "_leads",
        F.lower(F.hex("key")).alias("key"),
    )
    return out.select(
        "doc_id",
        "n_links",
        "component_id",
        (F.col("_leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "key",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id, then digest,
    stays (null ids last), and one row of those that repeat it; texts without words all stay. Columns are unchanged."""
    # rows get names of their own, so that of repeated rows exactly one stays
    names = docs.columns
    packed = docs.select(
        F.struct(*names).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.md5(F.coalesce("text", F.lit(""))).alias("_key"),
    )
    judged = ngram_jaccard_join(docs)
    stays = stage(judged.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("_n"), F.max("n_links").alias("_l")), "stays")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    alone = packed.join(stays.where("_n = 1 or _l = 0").hint("merge"), same, "left_semi").select("_row.*")  # grows with the rows
    if stays.where("_n > 1 and _l > 0").isEmpty():  # no row repeats a kept one: its texts need not move again
        return alone
    again = packed.join(
        stays.where("_n > 1 and _l > 0").hint("merge"), same
    ).groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return alone.unionByName(again)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_links", "component_id", "kept")
