"""Best-fit packing of token sequences by bin completion.

Documents are tokenized once and written as pieces (id, place, length). Only the histogram of
piece lengths, `capacity` numbers at most whatever the data, goes to the driver. There the bins are
found as patterns (lengths that share a bin, and how often): best-fit decreasing gives the first
incumbent; bin completion (Korf, "A New Algorithm for Optimal Bin Packing", 2002) then enumerates
undominated fillings of any number of pieces around the largest piece left, from a table of subset
sums, applies each as often as the counts allow, backtracks where the waste so far exceeds what a
better packing could have, and stops at the Martello-Toth lower bound or after `nodes` nodes beside
those of one whole path. Single paths that differ in their rule come first, for better incumbents. Pieces
find their places in the patterns by their
rank among the pieces of equal length: local ranks from the tokenizing tasks plus the sums of the
tasks before, so no length, however common, is gathered in one task.

Defined cases: a null or empty text is the end id alone; only documents longer than the capacity
are cut, so that all pieces but the first are full; repeated rows are packed each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .common import read_table, small, stage, texts

CAPACITY = 2048
END_ID = 0
#: Nodes of the branch and bound, beside those of one whole path, after which the incumbent stands.
NODES = 2_000
#: Fillings made for a node at a time; more follow when these are tried.
WIDTH = 4
#: Shares of the pieces at which dives change their rule.
BORDERS = 12
#: Pieces up to which dominance is tried in full, fillings that a new one is held against, and
#: dominated ones left out at a node (trying one all the same costs time only).
FEW, REMEMBERED, SKIPPED = 4, 64, 256


# ---------------------------------------------------------------- tokens


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters by which such tokenizer files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Tokens:
    """Ids of a tokenizers file as bytes.

    A plain byte-level BPE file, whose ids follow its merges, gives the same ids by ranks, which is
    faster (the tests compare both); any other file is run by the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
        letters = _byte_letters()
        if plain and all(
            vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)
        ) and sorted(vocab[c] for c in letters) == list(range(256)):
            special = {t["content"] for t in spec.get("added_tokens", ())}
            table = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.encode, most = ByteBpe(table).encode, max(table.values())
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode, most = lambda text: whole.encode(text, add_special_tokens=False).ids, whole.get_vocab_size()
        self.short = max(most, END_ID) < 1 << 16  # whether two bytes hold an id

    def ids(self, text: str) -> bytes:
        return _packed(self.encode(text))


_tokens: dict[str, Tokens] = {}


def load_tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    return [(0, first)] * (first > 0) + [(at, capacity) for at in range(first, total, capacity)]


# ---------------------------------------------------------------- bins

Patterns = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over a histogram (counts[s] pieces of length s)."""
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        n1 = n[capacity] - n[capacity - k]
        n2, s2 = n[capacity - k] - n[half], total[capacity - k] - total[half]
        s3 = total[half] - (total[k - 1] if k else 0)
        best = max(best, int(n1 + n2 + max(0, -(-(s3 - (n2 * capacity - s2)) // capacity))))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Patterns:
    """The bins of best-fit decreasing; bins that look alike are filled together."""
    rooms: list[int] = []  # distinct free spaces, sorted
    open_: dict[int, list[list]] = {}

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, times])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put((size,) * each, left // each, capacity - each * size)
                put((size,) * (left % each), int(left % each > 0), capacity - left % each * size)
                break
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full = min(times, left // each)
            put(pattern + (size,) * each, full, room - each * size)
            times, left = times - full, left - full * each
            if times and left:  # fewer are left than one bin takes
                put(pattern + (size,) * left, 1, room - left * size)
                times, left = times - 1, 0
            put(pattern, times, room)
    return [(p, t) for groups in open_.values() for p, t in groups]


def dominated(small: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether `by` could hold all pieces of `small`, its pieces taken as bins (both descending)."""
    if not small:
        return True
    seen = set()
    for i, room in enumerate(by):
        if room >= small[0] and room not in seen:
            seen.add(room)
            if dominated(small[1:], tuple(sorted((*by[:i], room - small[0], *by[i + 1 :]), reverse=True))):
                return True
    return False


def componentwise(small: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether `by` has a piece of at least its size for each of `small` (both descending)."""
    return len(small) <= len(by) and all(x <= y for x, y in zip(small, by, strict=False))


def subset_sums(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """Bit t of entry i: whether pieces of sizes[: i + 1] (ascending) can fill exactly t."""
    table, sums, mask = [], 1, (1 << room + 1) - 1
    for s, c in zip(sizes, counts, strict=True):
        c, step = min(c, room // s), 1
        while c:
            step = min(step, c)
            sums |= sums << s * step & mask
            c, step = c - step, 2 * step
        table.append(sums)
    return table


def exact_fillings(sizes: list[int], counts: list[int], table: list[int], target: int) -> Iterator[tuple[int, ...]]:
    """All choices of pieces that fill `target`, the largest pieces first; no step is a dead end."""
    todo = [(target, len(sizes) - 1, -1, ())]
    while todo:
        t, i, k, chosen = todo.pop()
        if not t:
            yield chosen
            continue
        while True:
            if k < 0:
                i = min(i, bisect_right(sizes, t) - 1)
                k = min(counts[i], t // sizes[i])
            below = table[i - 1] if i else 1
            while k and not below >> t - k * sizes[i] & 1:
                k -= 1
            if k:
                todo += [(t, i, k - 1, chosen), (t - k * sizes[i], i - 1, -1, chosen + (sizes[i],) * k)]
                break
            if not below >> t & 1:
                break
            i, k = i - 1, -1


def fillings(counts: np.ndarray, room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` with any number of the pieces left, least waste first.

    The empty filling comes only if nothing fits. Fillings that waste more than `waste` are left
    out, but for the best one, on which the caller prunes.
    """
    sizes = np.flatnonzero(counts[: room + 1] > 0).tolist()
    have = counts[sizes].tolist()
    table = subset_sums(sizes, have, room)
    if not table:
        yield ()
        return
    kept: list[tuple[int, ...]] = []
    sums, skipped = table[-1], 0
    while sums > 1:
        target = sums.bit_length() - 1
        sums ^= 1 << target
        if kept and room - target > waste:
            return
        # what still fits beside a filling is part of it, or another filling holds this one
        small = bisect_right(sizes, room - target)
        left = target - sum(s * c for s, c in zip(sizes[:small], have[:small], strict=True))
        if left < 0:
            return
        within = tuple(s for s, c in zip(sizes[:small], have[:small], strict=True) for _ in range(c))[::-1]
        rest = subset_sums(sizes[small:], have[small:], left) if small else table
        if left and not (rest and rest[-1] >> left & 1):
            continue
        for f in exact_fillings(sizes[small:], have[small:], rest, left):
            f += within
            if skipped < SKIPPED and any(componentwise(f, k) or (len(f) <= FEW and dominated(f, k)) for k in kept):
                skipped += 1
                continue
            if len(kept) < REMEMBERED:
                kept.append(f)
            yield f


def largest_first(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The filling that takes the largest piece that fits, again and again."""
    out: tuple[int, ...] = ()
    for s in np.flatnonzero(counts[: room + 1] > 0)[::-1].tolist():
        k = min(int(counts[s]), room // s)
        out += (s,) * k
        room -= k * s
    return out


class _Path:
    """Patterns applied one after the other to a histogram, each as often as the counts allow."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts.copy(), capacity
        self.patterns: Patterns = []
        self.wasted, self.used = 0, 0

    def apply(self, pattern: tuple[int, ...]) -> None:
        sizes, mult = np.unique(pattern, return_counts=True)
        times = int((self.counts[sizes] // mult).min())
        self.counts[sizes] -= mult * times
        self.wasted += (self.capacity - sum(pattern)) * times
        self.used += times
        self.patterns.append((pattern, times))

    def undo(self) -> None:
        pattern, times = self.patterns.pop()
        np.add.at(self.counts, list(pattern), times)
        self.wasted -= (self.capacity - sum(pattern)) * times
        self.used -= times

    def around_largest(self, fill) -> list[tuple[int, ...]]:
        """The largest piece left with each of the fillings that fill(counts, room) gives."""
        largest = int(np.flatnonzero(self.counts)[-1])
        self.counts[largest] -= 1
        out = [(largest, *f) for f in fill(self.counts, self.capacity - largest)]
        self.counts[largest] += 1
        return out


def dive(counts: np.ndarray, capacity: int, above: int, bins: int) -> tuple[Patterns, int] | None:
    """One path to the end, if it takes fewer than `bins` bins: pieces longer than `above` are
    joined by the largest that fit, the others by the filling of least waste."""
    path = _Path(counts, capacity)
    allowed = (bins - 1) * capacity - int((counts * np.arange(capacity + 1)).sum())
    while path.counts.any():
        if path.wasted > allowed:
            return None
        long = int(np.flatnonzero(path.counts)[-1]) > above
        path.apply(path.around_largest(lambda c, room: [largest_first(c, room)] if long else islice(fillings(c, room, capacity), 1))[0])  # noqa: B023
    return (path.patterns, path.used) if path.used < bins else None


def dives(counts: np.ndarray, capacity: int, bins: int, bound: int) -> Iterator[tuple[Patterns, int]]:
    """Ever better packings by dives that differ in how long the pieces are that take the largest.

    Filling every bin exactly can use up the short pieces that others need (of pieces of 350 to 500
    in 2048, five fit only if short), so the border is tried at even shares of the pieces, then
    between the best one and its neighbours.
    """
    rank = np.cumsum(counts)
    at = lambda share: int(np.searchsorted(rank, share * rank[-1] / BORDERS))
    best, step = float(BORDERS), 1.0
    shares = [float(x) for x in range(BORDERS, 0, -1)]
    tried: set[int] = set()
    while bins > bound and step > 1 / 64:
        for share in shares:
            if bins > bound and at(share) not in tried:
                tried.add(at(share))
                found = dive(counts, capacity, at(share), bins)
                if found:
                    bins, best = found[1], share
                    yield found
        step /= 2
        shares = [best - step, best + step]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[Patterns, int]:
    """The best packing found, as patterns, and the lower bound.

    Beside `nodes`, the search may take the nodes of one path to the end: a pattern applied leaves
    fewer pieces of some length than it holds, the next one at most half of them.
    """
    counts = np.array(counts, dtype=np.int64)
    if not counts.sum():
        return [], 0
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    bins = sum(t for _, t in best)
    total = int((counts * np.arange(capacity + 1)).sum())
    for best, bins in dives(counts, capacity, bins, bound):  # noqa: B020
        pass
    path = _Path(counts, capacity)
    choices: list[list] = []  # at each depth: what is untried, how many were made, whether there are more

    def more(made: int) -> list:
        """The node's next fillings; its counts are those of the path."""
        waste = (bins - 1) * capacity - total - path.wasted
        todo = path.around_largest(lambda c, room: islice(fillings(c, room, waste), made, made + WIDTH))
        return [todo[::-1], made + len(todo), len(todo) == WIDTH]

    for _ in range(nodes + sum(2 + (capacity // int(s)).bit_length() for s in np.flatnonzero(counts))):
        if bins <= bound:
            break
        if not path.counts.any():
            if path.used < bins:
                best, bins = list(path.patterns), path.used
            choices.append([[], 0, False])
        elif path.wasted > (bins - 1) * capacity - total:  # more than a better packing may waste
            choices.append([[], 0, False])
        else:
            choices.append(more(0))
        while choices and not choices[-1][0]:
            if choices[-1][2] and path.wasted <= (bins - 1) * capacity - total:
                choices[-1] = more(choices[-1][1])
                continue
            choices.pop()
            if path.patterns:
                path.undo()
        if not choices:
            break
        path.apply(choices[-1][0].pop())
    return best, bound


def layout(patterns: Patterns) -> dict[str, np.ndarray]:
    """Where the piece of rank r among those of its length goes: segments sorted by length and rank."""
    rows, next_rank, first = [], {}, 0
    for pattern, times in sorted(patterns, reverse=True):
        at = 0
        ordered = sorted(pattern, reverse=True)
        for size in dict.fromkeys(ordered):
            mult = ordered.count(size)
            rows.append((size, next_rank.get(size, 0), first, mult, at))
            next_rank[size] = next_rank.get(size, 0) + mult * times
            at += mult * size
        first += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "mult", "offset"), cols, strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of pieces."""
    i = np.searchsorted((table["length"] << 44) + table["rank"], (length << 44) + rank, side="right") - 1
    nth = rank - table["rank"][i]
    return table["sequence"][i] + nth // table["mult"][i], table["offset"][i] + nth % table["mult"][i] * length


# ---------------------------------------------------------------- the operator


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    nodes: int = NODES,
    keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids), and for the whole
    packing n_sequences and a proven lower bound of it, n_sequences_least: their difference is the search's gap."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_task"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, task = load_tokens(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in small(batches):
            rows: list[tuple] = []
            bodies: list[np.ndarray] = []
            for doc, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = tokens.ids(t) + END_ID.to_bytes(4, "little")
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    body = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, i, start, length, zlib.crc32(body), int(seen[length]), task))
                    seen[length] += 1
                    if keep_ids:
                        bodies.append(np.frombuffer(body, "<u4").astype("<u2").tobytes() if tokens.short else body)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32()] + [pa.int64()] * 4 + [pa.int32()], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(bodies, pa.binary())] * keep_ids, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _rank long, _task int" + ", ids binary" * keep_ids
    pieces = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema), "pieces")
    per_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in per_task.groupBy("length").agg(F.sum("_n")).collect():
        counts[size] = n
    patterns, least = bin_completion(counts, capacity, nodes)
    table, bins = layout(patterns), sum(t for _, t in patterns)

    def unpacked(column: pa.Array, length: np.ndarray) -> pa.Array:
        bodies = column.to_pylist()
        wide = len(bodies[0]) // int(length[0]) if bodies else 4  # a piece has its end id at least
        return pa.LargeListArray.from_arrays(
            np.r_[0, np.cumsum(length)], np.frombuffer(b"".join(bodies), f"<u{wide}").astype(np.int32)
        ).cast(pa.list_(pa.int32()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            sequence, offset = place(table, length, rank)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:5],
                    pa.array(sequence),
                    pa.array(offset),
                    *[unpacked(b.column(c), length) for c in ["ids"] * keep_ids],
                ],
                [*names[:5], "sequence_id", "offset", *["ids"] * keep_ids],
            )

    ranked = pieces.join(per_task.select("length", "_task", before.alias("_before")), ["length", "_task"]).select(
        *names[:5], (F.col("_rank") + F.col("_before")).alias("_rank"), *["ids"] * keep_ids
    )
    placed = ranked.mapInArrow(
        put,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids,
    )
    return placed.withColumns({"n_sequences": F.lit(bins).cast("long"), "n_sequences_least": F.lit(least).cast("long")})


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
