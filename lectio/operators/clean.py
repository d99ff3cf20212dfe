"""From raw page texts to clean ones: pagination, page repair, furniture, line-end hyphens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import HYPHEN_BREAK, compounds, hyphen_breaks, mask_line, normalize_whitespace, replace_breaks, standalone_words, words_ran_together


def paginate(texts: DataFrame) -> DataFrame:
    """doc_id, page_number, text from doc_id, text: pages end at form feeds; blank pages keep their number."""
    return texts.select(
        "doc_id", F.posexplode(F.split("text", "\f", -1)).alias("n", "text")
    ).select("doc_id", (F.col("n") + 1).alias("page_number"), "text")


def nonblank(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("text").rlike(r"\S"))


def repair_pages(pages: DataFrame, fallback: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pages whose words ran together, taken from the other extractor where its page is healthy."""
    other = fallback.select("doc_id", "page_number", F.col("text").alias("_other"))
    better = words_ran_together(F.col("text"), config) & F.col("_other").isNotNull() & ~words_ran_together(F.col("_other"), config)
    return pages.join(other, ["doc_id", "page_number"], "left").select(
        "doc_id", "page_number", F.when(better, F.col("_other")).otherwise(F.col("text")).alias("text")
    )


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, n, line, key (the masked line, null for blank ones)."""
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return rows.withColumn("key", F.when(F.col("line").rlike(r"\S"), mask_line(F.col("line"))))


def line_recurrence(pages: DataFrame) -> DataFrame:
    """doc_id, key, pages_with: on how many pages of its document a masked line occurs."""
    seen = lines_of(pages).where(F.col("key").isNotNull()).select("doc_id", "page_number", "key").distinct()
    return seen.groupBy("doc_id", "key").agg(F.count("*").alias("pages_with"))


def furniture_lines(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page_number, n, line, drop: drop marks unbroken runs of recurring lines at a page's ends.

    Over the lines that aren't blank, the running minimum of "recurs" from the top (and from the
    bottom) is 1 exactly within the run.
    """
    count = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = line_recurrence(pages).join(count, "doc_id").where(
        (F.col("pages") >= config.furniture_min_pages) & (
            F.col("pages_with") >= F.greatest(F.lit(2), F.bround(config.furniture_min_fraction * F.col("pages")))
        )
    ).select("doc_id", "key", F.lit(1).alias("recurs"))
    flagged = lines_of(pages).join(often, ["doc_id", "key"], "left")
    run = lambda order: F.min(F.when(F.col("key").isNotNull(), F.coalesce("recurs", F.lit(0)))).over(
        Window.partitionBy("doc_id", "page_number").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    hit = F.col("key").isNotNull() & ((run(F.col("n")) == 1) | (run(F.desc("n")) == 1))
    return flagged.select("doc_id", "page_number", "n", "line", F.coalesce(hit, F.lit(False)).alias("drop"))


def strip_furniture(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page_number, text without running heads and feet; a document that would lose nearly all stays."""
    kept = furniture_lines(pages, config).groupBy("doc_id", "page_number").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("n", "line")))), lambda x: x["line"]
            ),
            "\n",
        ).alias("_clean")
    )
    both = pages.join(kept, ["doc_id", "page_number"])
    total = Window.partitionBy("doc_id")
    share = F.try_divide(F.sum(F.length("text") - F.length("_clean")).over(total), F.sum(F.length("text")).over(total))
    return both.select(
        "doc_id",
        "page_number",
        F.when(share > config.furniture_max_document_fraction, F.col("text")).otherwise(F.col("_clean")).alias("text"),
    )


def vocabulary(pages: DataFrame) -> DataFrame:
    """doc_id, words, pairs: what each document writes elsewhere."""
    own = pages.select("doc_id", standalone_words(F.col("text")).alias("w"), compounds(F.col("text")).alias("c"))
    return own.groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_list("w"))).alias("words"),
        F.array_distinct(F.flatten(F.collect_list("c"))).alias("pairs"),
    )


def rejoin_hyphens(pages: DataFrame) -> DataFrame:
    """Words broken at a line end, joined or kept as compounds by what the document writes elsewhere.

    Only the forms that breaks ask for are looked up: breaks are exploded and meet the document's words by
    join, so that no word list travels to its pages.
    """
    page = ["doc_id", "page_number"]
    hits = pages.select(*page, F.posexplode(hyphen_breaks(F.col("text"))).alias("n", "hit"))
    left, right = F.regexp_extract("hit", HYPHEN_BREAK, 1), F.regexp_extract("hit", HYPHEN_BREAK, 2)
    l, r = F.lower(left), F.lower(right)
    form = lambda role, kind, term: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), term.alias("term"))
    forms = F.array(
        form("joined", "word", F.concat(l, r)),
        form("pair", "pair", F.concat(l, F.lit("-"), r)),
        form("left", "word", l),
        form("right", "word", r),
    )
    asked = hits.select(
        *page, "n", left.alias("left"), right.alias("right"), F.explode(forms).alias("f")
    ).select(*page, "n", "left", "right", "f.*")
    own = lambda kind, words: pages.select("doc_id", F.lit(kind).alias("kind"), F.explode(words).alias("term"))
    written = own("word", standalone_words(F.col("text"))).unionByName(own("pair", compounds(F.col("text"))))
    keys = ["doc_id", "kind", "term"]
    known = written.join(asked.select(*keys), keys, "left_semi").distinct().withColumn("_known", F.lit(True))
    has = lambda role: F.coalesce(F.bool_or((F.col("role") == role) & F.col("_known")), F.lit(False))
    found = asked.join(known, keys, "left").groupBy(*page, "n", "left", "right").agg(
        has("joined").alias("j"), has("pair").alias("p"), (has("left") & has("right")).alias("b")
    )
    kept = ~F.col("j") & (F.col("p") | F.col("b"))
    word = F.when(kept, F.concat("left", F.lit("-"), "right")).otherwise(F.concat("left", "right"))
    chosen = found.groupBy(*page).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", word.alias("w")))), lambda x: x["w"]).alias("_words")
    )
    joined = pages.join(chosen, page, "left")
    return joined.select(
        *page,
        F.when(F.col("_words").isNull(), F.col("text")).otherwise(
            replace_breaks(F.col("text"), F.col("_words"))
        ).alias("text"),
    )


def preprocess(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pages(doc_id, page_number, text, from_layout) -> clean pages, blank ones dropped."""
    laid = pages.select("doc_id", "page_number", "from_layout", normalize_whitespace(F.col("text"), F.col("from_layout")).alias("text"))
    flags = laid.select("doc_id", "page_number", "from_layout")
    bare = strip_furniture(laid.drop("from_layout"), config)
    whole = rejoin_hyphens(bare).withColumnRenamed("text", "_joined").join(bare, ["doc_id", "page_number"]).join(
        flags, ["doc_id", "page_number"]
    )
    text = F.when(F.col("from_layout"), F.col("_joined")).otherwise(F.col("text"))
    return nonblank(whole.select("doc_id", "page_number", normalize_whitespace(text, F.col("from_layout")).alias("text")))


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id, text (pages joined by a newline), page_count."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
        F.count("*").cast("int").alias("page_count"),
    )


def page_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, start, end of each page in its document's text."""
    before = F.coalesce(
        F.sum(F.length("text") + 1).over(
            Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return pages.select("doc_id", "page_number", before.alias("start"), (before + F.length("text")).alias("end"))


def attribute_pages(spans: DataFrame, page_table: DataFrame) -> DataFrame:
    """spans(doc_id, span_id, start, end) with the page of the largest overlap, the first of equal ones."""
    p = page_table.select(F.col("doc_id"), "page_number", F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    met = spans.join(p, "doc_id", "left").where(F.col("_ps").isNull() | ((F.col("_ps") < F.col("end")) & (F.col("_pe") >= F.col("start"))))
    overlap = F.least("end", "_pe") - F.greatest("start", "_ps")
    best = met.withColumn(
        "_r", F.row_number().over(Window.partitionBy("doc_id", "span_id").orderBy(F.desc(overlap), "page_number"))
    ).where("_r = 1").select("doc_id", "span_id", "page_number")
    return spans.join(best, ["doc_id", "span_id"], "left")
