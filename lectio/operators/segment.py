"""Sentences, topic groups, token-bounded packing, overlap, chunk ids: text to chunks by offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import dot, sentences, strip, token_count, word_start
from ..sources.staging import stage


def sentence_spans(sections: DataFrame, texts: DataFrame, count=token_count) -> DataFrame:
    """doc_id, section_index, i, start, end, sentence, n_tokens (by `count`) of the sentences that aren't blank."""
    body = sections.join(texts.select("doc_id", "text"), "doc_id").select(
        "doc_id",
        "section_index",
        F.col("start").alias("_s"),
        F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("_b"),
    )
    rows = body.select("doc_id", "section_index", "_s", F.posexplode(sentences(F.col("_b"))).alias("_n", "sentence"))
    w = Window.partitionBy("doc_id", "section_index").orderBy("_n")
    before = F.coalesce(F.sum(F.length("sentence")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(
        "doc_id", "section_index", "_n", (F.col("_s") + before).cast("int").alias("start"), "sentence"
    ).where(F.col("sentence").rlike(r"\S"))
    return placed.select(
        "doc_id",
        "section_index",
        (F.row_number().over(w) - 1).alias("i"),
        "start",
        (F.col("start") + F.length("sentence")).alias("end"),
        "sentence",
        count(F.col("sentence")).alias("n_tokens"),
    )


def neighbour_distance(vectors: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds dist, one minus the product with the next vector (nine digits), null for the last."""
    following = F.lead("vector").over(Window.partitionBy(*by).orderBy(order))
    return vectors.withColumn("dist", F.when(following.isNotNull(), F.round(1 - dot(F.col("vector"), following), 9)))


def topic_groups(rows: DataFrame, by: list[str], order: str, config: Config = DEFAULT) -> DataFrame:
    """Adds topic: it steps on where the distance lies strictly above the section's percentile.

    Both sides of the comparison are rounded, so that equal distances stay equal after interpolation.
    """
    limit = F.round(F.percentile("dist", F.lit(config.breakpoint_percentile / 100)).over(Window.partitionBy(*by)), 9)
    w = Window.partitionBy(*by).orderBy(order)
    breaks = rows.withColumn("_limit", limit).withColumn(
        "_cut", F.coalesce((F.lag("dist").over(w) > F.col("_limit")).cast("int"), F.lit(0))
    )
    return breaks.withColumn("topic", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "_limit")


def packs_of(topics: list[int], sizes: list[int], low: int, high: int) -> list[tuple[int, bool]]:
    """(pack, hard) of each sentence of a section, in one pass each for merging and cutting.

    Topics join a predecessor that is still under the minimum; a last group under it joins its
    predecessor; groups over the maximum are cut between sentences, and a lone sentence over it is hard.
    """
    group, total = [], []
    for k, (topic, n) in enumerate(zip(topics, sizes, strict=True)):
        if not k or (topic != topics[k - 1] and total[-1] >= low):
            total.append(0)
        total[-1] += n
        group.append(len(total) - 1)
    if len(total) > 1 and total[-1] < low:
        total[-2] += total.pop()
        group = [min(g, len(total) - 1) for g in group]
    out: list[tuple[int, bool]] = []
    pack, held, after_hard = -1, 0, False
    for k, (g, n) in enumerate(zip(group, sizes, strict=True)):
        whole = total[g] <= high
        hard = not whole and n > high
        if not k or g != group[k - 1] or (not whole and (hard or after_hard or held + n > high)):
            pack, held = pack + 1, 0
        held, after_hard = held + n, hard
        out.append((pack, hard))
    return out


def pack_sentences(rows: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """rows(by, i, topic, n_tokens) with pack (chunk number in the section) and hard (a lone
    sentence over the limit, to be cut by characters)."""
    low, high = config.chunk_min_tokens, config.chunk_max_tokens

    def run(topics: pd.Series, sizes: pd.Series) -> pd.Series:
        found = [packs_of(list(t), list(n), low, high) for t, n in zip(topics, sizes, strict=True)]
        return pd.Series([[{"pack": p, "hard": h} for p, h in f] for f in found], dtype=object)

    run.__annotations__ = {"topics": pd.Series, "sizes": pd.Series, "return": pd.Series}
    packs = F.pandas_udf(run, "array<struct<pack:int,hard:boolean>>")
    listed = rows.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(
                F.struct("i", F.col("topic").cast("int").alias("topic"), F.col("n_tokens").cast("int").alias("n"))
            )
        ).alias("s")
    )
    placed = listed.withColumn("p", packs(F.transform("s", lambda x: x["topic"]), F.transform("s", lambda x: x["n"])))
    packed = placed.select(
        *by,
        F.explode(
            F.zip_with(
                "s", "p", lambda s, p: F.struct(s["i"].alias("i"), p["pack"].alias("pack"), p["hard"].alias("hard"))
            )
        ).alias("z"),
    ).select(*by, "z.i", "z.pack", "z.hard")
    return rows.join(packed, [*by, "i"])


def recursive_spans(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Spans of a text cut to at most `size` characters where its widest breaks allow it.

    Breaks are tried from blank lines over line ends and blanks to single characters: a part that is
    still too long behind one kind of break is cut at the next kind, a break stays with the part behind
    it, and neighbouring parts are joined while they fit. A piece starts with as many of its predecessor's last
    parts as make up at most `overlap` characters. White space around a piece isn't part of it, and its
    place is where its text occurs first from `overlap` before its predecessor's end.
    """
    pieces: list[tuple[int, int]] = []

    def join(parts: list[tuple[int, int]]) -> None:
        held: list[tuple[int, int]] = []
        total = 0
        for begin, end in parts:
            if total + end - begin > size and held:
                pieces.append((held[0][0], held[-1][1]))
                while total > overlap or (total + end - begin > size and total > 0):
                    total -= held[0][1] - held[0][0]
                    held.pop(0)
            held.append((begin, end))
            total += end - begin
        if held:
            pieces.append((held[0][0], held[-1][1]))

    def cut(begin: int, end: int, breaks: tuple[str, ...]) -> None:
        at = next((i for i, b in enumerate(breaks) if not b or text.find(b, begin, end) >= 0), len(breaks) - 1)
        if breaks[at]:
            marks = [begin]
            found = text.find(breaks[at], begin, end)
            while found >= 0:
                marks.append(found)
                found = text.find(breaks[at], found + len(breaks[at]), end)
            marks.append(end)
        else:
            marks = list(range(begin, end + 1))
        small: list[tuple[int, int]] = []
        for part in zip(marks, marks[1:], strict=False):
            if part[0] == part[1]:
                continue
            if part[1] - part[0] < size:
                small.append(part)
                continue
            join(small)
            small = []
            if at + 1 < len(breaks):
                cut(*part, breaks[at + 1 :])
            else:
                pieces.append(part)
        join(small)

    cut(0, len(text), ("\n\n", "\n", " ", ""))
    out: list[tuple[int, int]] = []
    index = last = 0
    for begin, end in pieces:
        body = text[begin:end].strip()
        if body:
            index = text.find(body, max(0, index + last - overlap))
            last = len(body)
            out.append((index, index + last))
    return out


def char_pieces(text: Column, size: int, overlap: int = 0) -> Column:
    """recursive_spans of a text column, as structs (start, end). Only texts that are cut by characters come here."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in recursive_spans(t, size, overlap)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<start:int,end:int>>")(text)


def overlap_start(text: Column, section_start: Column, start: Column, config: Config = DEFAULT) -> Column:
    opening = F.greatest(section_start, start - config.chunk_overlap)
    return word_start(text, opening, start)


def fixed_spans(sections: DataFrame, texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, section_index, n, start, end: the character cut inside sections, without topics."""
    body = sections.join(texts.select("doc_id", "text"), "doc_id")
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = body.select(
        "doc_id",
        "section_index",
        F.col("start").alias("_s"),
        F.posexplode(char_pieces(part, config.chunk_size, config.chunk_overlap)).alias("n", "p"),
    )
    return rows.select(
        "doc_id",
        "section_index",
        "n",
        (F.col("_s") + F.col("p.start")).alias("start"),
        (F.col("_s") + F.col("p.end")).alias("end"),
    )


def semantic_spans(sections: DataFrame, texts: DataFrame, embedder=None, config: Config = DEFAULT, count=token_count) -> DataFrame:
    """doc_id, section_index, n, start, end with overlap. Without vectors (no embedder, one that fails
    when asked, or one that fails in a worker for any sentence of the document) a section is one topic, and
    only the token bounds cut it."""
    from ..models import EmbeddingError, or_null

    keys = ["doc_id", "section_index"]
    body = sections.join(texts.select("doc_id", "text"), "doc_id")
    alone = F.col("header").isNotNull() & (
        strip(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))) == F.col("header")
    )
    kept = body.where(~F.coalesce(alone, F.lit(False))).select(*sections.columns)
    spans = stage(sentence_spans(kept, texts, count), "sentences")
    try:
        vector = or_null(embedder).embed(strip(F.col("sentence"))) if embedder is not None else None
    except EmbeddingError:
        vector = None
    if vector is None:
        grouped = spans.withColumn("topic", F.lit(0))
    else:
        apart = stage(neighbour_distance(spans.withColumn("vector", vector).withColumn("_failed", F.col("vector").isNull()), keys, "i").drop("vector"), "distances")  # the vectors are made once
        failed = apart.where("_failed").select("doc_id").distinct().withColumn("_whole", F.lit(True))
        known = apart.join(failed, "doc_id", "left").withColumn(
            "dist", F.when(F.col("_whole").isNull(), F.col("dist"))
        ).drop("_failed", "_whole")
        grouped = stage(topic_groups(known, keys, "i", config).drop("dist"), "topics")
    packed = pack_sentences(grouped, keys, config)
    runs = packed.groupBy(*keys, "pack").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("hard").alias("hard"))
    runs = runs.join(texts.select("doc_id", "text"), "doc_id").join(kept.select(*keys, F.col("start").alias("_section")), keys)
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    pieces = F.when(F.col("hard"), char_pieces(part, config.chunk_size)).otherwise(
        F.array(F.struct(F.lit(0).alias("start"), (F.col("end") - F.col("start")).alias("end")))
    )
    rows = runs.select(*keys, "text", "_section", "start", F.explode(pieces).alias("p")).select(
        *keys,
        "text",
        "_section",
        (F.col("start") + F.col("p.start")).alias("start"),
        (F.col("start") + F.col("p.end")).alias("end"),
    )
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).alias("n")
    numbered = rows.select(*keys, "text", "_section", "start", "end", n)
    return numbered.select(
        *keys,
        "n",
        F.when(
            F.col("n") > 0, overlap_start(F.col("text"), F.col("_section"), F.col("start"), config)
        ).otherwise(F.col("start")).alias("start"),
        "end",
    )


def section_counts(sections: DataFrame) -> DataFrame:
    """doc_id, n_sections, n_headed: the sections found, and those with a heading."""
    return sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count_if(F.col("header").isNotNull()).alias("n_headed"))


def chunk_id(doc_id: Column, page: Column, section: Column, number: Column) -> Column:
    padded = F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return F.concat(
        doc_id,
        F.lit("_p"),
        F.coalesce(page.cast("string"), F.lit("0")),
        F.lit("_s"),
        section.cast("string"),
        F.lit("_"),
        padded,
    )


def chunk_table(documents: DataFrame, pages: DataFrame, embedder=None, config: Config = DEFAULT, counter=None) -> DataFrame:
    """The chunk schema from documents(doc_id, source_file) and their clean pages.

    counter: the token counter of the model that will read the chunks (models.TokenCounter)."""
    from .clean import attribute_pages, document_text, page_spans
    from .outline import sections

    texts = stage(document_text(pages), "texts")
    count = counter.count if counter is not None else token_count
    parts = stage(sections(texts, config), "sections")
    spans = semantic_spans(parts, texts, embedder, config, count) if config.semantic_chunking else fixed_spans(parts, texts, config)
    body = spans.join(texts.select("doc_id", "text"), "doc_id").join(
        parts.select("doc_id", "section_index", "header"), ["doc_id", "section_index"]
    )
    body = body.withColumn(
        "chunk_text", strip(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    ).where("chunk_text <> ''").drop("text")
    w = Window.partitionBy("doc_id").orderBy("section_index", "n")
    body = body.withColumn("span_id", F.row_number().over(w) - 1)
    placed = attribute_pages(body, page_spans(pages)).join(documents.select("doc_id", "source_file"), "doc_id")
    ident = chunk_id(F.col("doc_id"), F.col("page_number"), F.col("section_index"), F.col("span_id"))
    return placed.select(
        ident.alias("chunk_id"),
        "doc_id",
        "source_file",
        "chunk_text",
        F.col("start").alias("char_start"),
        F.col("end").alias("char_end"),
        count(F.col("chunk_text")).cast("int").alias("token_count"),
        "page_number",
        F.col("header").alias("section_header"),
        F.col("span_id").cast("long").alias("ord"),
    )
