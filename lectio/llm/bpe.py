"""Byte-level BPE with the tiktoken library and a local rank file.

The split pattern's only look-ahead, `\\s+(?!\\S)`, matters where two or more whitespace characters
come before another character. Texts are cut there first, before the run's last whitespace
character, which is where the pattern cuts as well; on the parts a pattern without look-ahead
gives the same matches, in linear time and without a backtracking stack. Long texts are further
cut before a whitespace character that follows another one: no match reaches over such a place,
and none looks back. Each part is encoded by tiktoken; decoding joins the tokens' raw bytes.

Defined cases: a null text is empty (no tokens, the digests of nothing); special-token strings
are ordinary text; whole texts are encoded; repeated rows give repeated results; an empty table
an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small, texts

#: White_Space of Unicode, as the split pattern's \s has it (Python's \s has U+001C to 1F besides).
SPACES = "\t-\r \x85\xa0  -     　"
_DOUBLE = re.compile(f"[{SPACES}][{SPACES}]")
_BEFORE_LAST = re.compile(f"(?<=[{SPACES}])(?=[{SPACES}][^{SPACES}])")
_SAFE = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_RARE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a part of a long text.
PART = 1 << 16


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def has_run(text: str) -> bool:
    """Whether two whitespace characters stand side by side; mostly a few substring searches."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _RARE) and bool(_DOUBLE.search(text))


def parts(text: str, size: int = PART) -> list[str]:
    """Parts of the text whose matches, one part after the other, are the whole text's."""
    cut = _BEFORE_LAST.split(text) if has_run(text) else [text]
    if len(text) <= size:
        return cut
    out = []
    for piece in cut:
        at = 0
        while len(piece) - at > size:
            safe = _SAFE.search(piece, at + size)
            if not safe:
                break
            out.append(piece[at : safe.start()])
            at = safe.start()
        out.append(piece[at:] if at else piece)
    return out


class ByteBpe:
    """encode(text) to a list of ids, decode(ids) to bytes."""

    @classmethod
    def from_file(cls, ranks: str) -> ByteBpe:
        with open(ranks, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})

    def __init__(self, table: dict[bytes, int]):
        import public_tokenizers
        import tiktoken

        head, look, tail = public_tokenizers.PATTERN.partition(r"|\s+(?!\S)")
        if not look or tail != r"|\s+":
            raise ValueError("the split pattern isn't the one that parts() is made for")
        self._coder = tiktoken.Encoding("local", pat_str=head + tail, mergeable_ranks=table, special_tokens={})
        self.digits = [str(i) for i in range(max(table.values()) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART and not has_run(text):
            return self._coder.encode_ordinary(text)
        out: list[int] = []
        for part in parts(text):
            out += self._coder.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self._coder.decode_bytes(ids)


_loaded: dict[str, ByteBpe] = {}


def load(ranks: str) -> ByteBpe:
    """One coder for each worker process and rank file."""
    if ranks not in _loaded:
        _loaded[ranks] = ByteBpe.from_file(ranks)
    return _loaded[ranks]


def encode_documents(docs: DataFrame, ranks: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the general interface."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in small(batches):
            ids = [np.array(coder.encode(t), np.int32) for t in texts(b.column(1))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            rows = pa.LargeListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *ids])).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, content (binary): the raw bytes of the ids; null ids count as none."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())],
                ["doc_id", "content"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids stay in the worker, document by document."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        digits = coder.digits.__getitem__
        for b in small(batches):
            counts, ids_sha, out_sha = [], [], []
            for t in texts(b.column(1)):
                ids = coder.encode(t)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(out_sha, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
