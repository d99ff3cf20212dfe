"""Around the answer: context budget and rendering, history, query phrasings, citations, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import REFUSAL, cited_markers, clean_lines, confidence, content_words, squeeze, tokenize, verdicts

WITHDRAWN = "The retrieved excerpts do not support an answer to this question."


def context_budget(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """ranked(query_id, rank, token_count, ...): the best-first prefix within the budget, the first always."""
    total = F.sum("token_count").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_total", total).where((F.col("_total") <= config.max_context_tokens) | (F.col("rank") == 1)).drop("_total")


def excerpt(marker: Column, source: Column, page: Column, section: Column, text: Column) -> Column:
    tag = F.concat(F.lit("["), marker.cast("string"), F.lit("] "), source)
    page_part = F.coalesce(F.concat(F.lit(", p."), page.cast("string")), F.lit(""))
    section_part = F.when(section != "", F.concat(F.lit(', "'), section, F.lit('"'))).otherwise("")
    return F.concat(tag, page_part, F.coalesce(section_part, F.lit("")), F.lit("\n"), text)


def format_context(context: DataFrame) -> DataFrame:
    """query_id, context from rows (query_id, marker, source_file, page_number, section_header, chunk_text)."""
    part = F.struct(
        "marker",
        excerpt(
            F.col("marker"), F.col("source_file"), F.col("page_number"), F.col("section_header"), F.col("chunk_text")
        ).alias("t"),
    )
    return context.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("context")
    )


def history_window(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """conv_id, turn_no, line of the latest turns; turns(conv_id, turn_no, question, answer)."""
    flat = squeeze(F.col("answer"))
    cut = F.when(
        F.length(flat) > config.answer_excerpt_chars,
        F.concat(F.rtrim(F.substring(flat, 1, config.answer_excerpt_chars)), F.lit("…")),
    ).otherwise(flat)
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn_no")))
    return turns.withColumn("_n", newest).where(F.col("_n") <= config.history_turns).select(
        "conv_id", "turn_no", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), cut).alias("line")
    )


def conversation_prompt(turns: DataFrame, questions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """conv_id, prompt: the latest turns and the question that follows them."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "line"))), lambda x: x["line"]), "\n\n")
    past = history_window(turns, config).groupBy("conv_id").agg(lines.alias("past"))
    return questions.join(past, "conv_id", "left").select(
        "conv_id",
        F.concat_ws("\n\n", "past", F.concat(F.lit("Follow-up question: "), F.col("question"))).alias("prompt"),
    )


def search_texts(questions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """query_id, mode, side, variant_no, text from questions(query_id, question, mode, reply).

    reply is the model's raw text, null where the call failed: the question then stands for itself
    and the mode reads "none". multi_query keeps the question first and repeats nothing away;
    hyde searches the vectors with the passage and the words with the question.
    """
    lines = F.coalesce(clean_lines(F.col("reply")), F.array().cast("array<string>"))
    mode = F.when((F.size(lines) == 0) | ~F.col("mode").isin("rewrite", "multi_query", "hyde"), "none").otherwise(F.col("mode"))
    rows = questions.select("query_id", squeeze(F.col("question")).alias("q"), mode.alias("mode"), lines.alias("lines"))
    several = F.concat(F.array("q"), F.slice("lines", 1, config.multi_query_count))
    dense = F.when(F.col("mode") == "rewrite", F.slice("lines", 1, 1)).when(F.col("mode") == "multi_query", several).when(
        F.col("mode") == "hyde", F.array(F.array_join("lines", " "))
    ).otherwise(F.array("q"))
    sparse = F.when(F.col("mode") == "hyde", F.array("q")).otherwise(dense)
    side = lambda name, texts: rows.select(
        "query_id", "mode", F.lit(name).alias("side"), F.posexplode(texts).alias("variant_no", "text")
    )
    return side("dense", dense).unionByName(side("sparse", sparse))


def mark_citations(context: DataFrame, answers: DataFrame) -> DataFrame:
    """context rows (query_id, marker, ...) with cited; answers(query_id, answer). Unknown markers are ignored."""
    used = answers.select("query_id", cited_markers(F.col("answer")).alias("_used"))
    return context.join(used, "query_id", "left").withColumn(
        "cited", F.coalesce(F.array_contains("_used", F.col("marker")), F.lit(False))
    ).drop("_used")


def overlap_score(answer: Column, context: Column) -> Column:
    """Share of the answer's content words that the context (an array of texts) has; 1 without any."""
    words = content_words(answer)
    there = F.array_distinct(F.flatten(F.transform(context, tokenize)))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, there)) / F.size(words))


def judge_score(reply: Column) -> Column:
    yes, no = verdicts(reply)
    return F.when(yes + no > 0, yes / (yes + no))


def grounding(answers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """answers(query_id, answer, n_context, context array, reply) with method, score, confidence,
    downgraded and the final answer. A null or wordless reply falls back to the overlap score."""
    none = (F.col("n_context") == 0) | (F.col("answer") == REFUSAL)
    judged = judge_score(F.col("reply"))
    method = F.when(none, None).when(judged.isNotNull(), "judge").otherwise("overlap")
    rows = answers.withColumn("method", method).withColumn(
        "score", F.when(~none, F.round(F.coalesce(judged, overlap_score(F.col("answer"), F.col("context"))), 9))
    )
    down = F.coalesce((F.col("method") == "judge") & (F.col("score") < config.grounding_threshold), F.lit(False))
    return rows.withColumn("confidence", confidence(F.col("score"), F.col("method"), config)).withColumn("downgraded", down).withColumn(
        "final_answer", F.when(down, WITHDRAWN).otherwise(F.col("answer"))
    )


def citation_view(citations: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """query_id, place, heading, body; cited ones first, files of one name told apart by their hash."""
    names = citations.groupBy("query_id", "source_file").agg((F.countDistinct("doc_id") > 1).alias("_twice"))
    rows = citations.join(names, ["query_id", "source_file"])
    name = F.when(
        F.col("_twice") & (F.col("doc_id") != ""),
        F.concat("source_file", F.lit(" ("), F.element_at(F.split("doc_id", "-"), -1), F.lit(")")),
    ).otherwise(F.col("source_file"))
    trail = F.concat_ws(
        " · ",
        F.concat(F.lit("**["), F.col("marker").cast("string"), F.lit("]** "), name),
        F.concat(F.lit("p. "), F.col("page_number").cast("string")),
        F.when(F.col("section_header") != "", F.col("section_header")),
    )
    heading = F.concat(trail, F.when(F.col("cited"), " — cited").otherwise(" — not cited"))
    flat, most = squeeze(F.col("snippet")), config.uncited_preview_chars
    body = F.concat(
        F.lit("> "),
        F.when(
            ~F.col("cited") & (F.length(flat) > most), F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))
        ).otherwise(flat),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cited"), "marker"))
    return rows.select("query_id", place.alias("place"), heading.alias("heading"), body.alias("body"))


def citation_summary(citations: DataFrame) -> DataFrame:
    n, used = F.count("*"), F.count_if("cited")
    label = F.when(
        used > 0,
        F.concat(F.lit("Sources: "), used.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" excerpts cited")),
    ).otherwise(F.concat(F.lit("Sources: "), n.cast("string"), F.lit(" excerpts, none cited")))
    return citations.groupBy("query_id").agg(used.alias("n_cited"), n.alias("n_total"), label.alias("label"))


def confidence_text(score: Column, method: Column) -> Column:
    share = F.concat(F.bround(score * 100).cast("int").cast("string"), F.lit("%"))
    return F.when(score.isNull(), None).when(method == "judge", F.concat(share, F.lit(" of the claims are supported by the excerpts."))).otherwise(
        F.concat(share, F.lit(" of the words appear in the excerpts; the claims were not checked one by one."))
    )


def pipeline_caption(mode: Column, standalone: Column, retrieved: Column, used: Column) -> Column:
    return F.concat_ws(
        " · ",
        F.concat(F.lit("transform: "), F.coalesce(mode, F.lit("none"))),
        F.concat(F.lit("read as: "), standalone),
        F.concat(F.lit("retrieved: "), retrieved.cast("string")),
        F.concat(F.lit("in context: "), used.cast("string")),
    )
