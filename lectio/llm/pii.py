"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds with a fixed definition ("base"): email, ip, card, phone. They are kept whatever their score.
Further kinds, kept from a score of `KEEP` on: iban (mod-97; stands alone), and those that only a context
word lifts over it: ssn, secret (a mixed string of 16 characters or more with the entropy of a key, near
"token", "password" and the like) and account (a bare number near "account" and the like).
Patterns run in linear time over any text: an email is grown from its "@", digit runs are entered
only at their start and possessively.

Defined cases: a null text is empty and has no spans; whole texts are scanned; repeated rows give
repeated results; an empty table an empty result; further columns are ignored (or, by redact_pii,
kept unchanged).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "account")
BASE_KINDS = KINDS[:4]
KEEP = 0.7
#: Characters before and after a span in which context words count.
CONTEXT = 48
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4, "account": 0.4}
#: What a context word adds: more for kinds that it decides.
ADDED = {kind: 0.4 if PRIOR[kind] < KEEP else 0.15 for kind in KINDS}
#: Bits a character that a secret has at least.
ENTROPY = 3.0
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "key", "auth", "bearer", "credential", "credentials"),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{8,17}(?![A-Za-z0-9-])")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the rearranged number, letters as 10 to 35, leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def keylike(value: str) -> bool:
    """Whether a string mixes letters and digits with the entropy of a random key."""
    if sum(map(str.isdigit, value)) < 3 or sum(map(str.isalpha, value)) < 3:
        return False
    counts = Counter(value).values()
    return -sum(n / len(value) * log2(n / len(value)) for n in counts) >= ENTROPY


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def _proposals(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from emails(text)
    elif kind == "ip":
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                yield m.span()
    elif kind == "card":
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                yield m.span()
    elif kind == "phone":
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.span()
    elif kind == "iban":
        for m in _IBAN.finditer(text):
            words = m[0].split(" ")
            while words:  # upper-case words that follow don't belong to it
                if 15 <= len(whole := "".join(words)) <= 34 and mod97(whole):
                    yield m.start(), m.start() + len(" ".join(words))
                    break
                words.pop()
    elif kind == "secret":
        for m in _SECRET.finditer(text):
            if keylike(m[0]):
                yield m.span()
    else:
        for m in (_SSN if kind == "ssn" else _ACCOUNT).finditer(text):
            yield m.span()


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; offsets in code points, end exclusive."""
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for start, end in _proposals(kind, text):
            near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower())) | set(_WORD.findall(text[end : end + CONTEXT].lower()))
            score = min(1.0, PRIOR[kind] + ADDED[kind] * bool(near & set(CONTEXT_WORDS[kind])))
            if kind in BASE_KINDS or score >= KEEP:
                out.append((kind, start, end, score))
    return out


def redact(text: str) -> str:
    """The text with each span, overlapping ones merged, replaced by its first kind's name in brackets."""
    spans = sorted((s, e, k) for k, s, e, _ in find_pii(text))
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, score), sorted by kind and start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_pii(t)] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data replaced in `text`, n_chars (if there) renewed."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            clean = [None if t is None else redact(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, derived from the operator's spans with column functions."""
    found = pii_spans(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        scores.alias("scores"),
        *[count(k) for k in KINDS if k not in BASE_KINDS],
        (F.size("spans") > 0).cast("int").alias("has_any"),
    )
