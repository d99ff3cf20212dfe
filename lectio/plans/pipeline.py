"""Whole flows: files to index, questions to grounded answers, many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import REFUSAL, document_id, needs_condensing, normalize_citations, squeeze
from ..models import chat_udf, or_null
from ..operators.answer import context_budget, conversation_prompt, format_context, grounding, mark_citations, search_texts
from ..operators.retrieval import hybrid_search, rerank
from ..operators.segment import chunk_table
from ..sources.files import SUPPORTED, load, scan_files
from ..sources.staging import stage
from ..sources.store import Index, chunk_counts

# Own wording throughout.
ANSWER = f"Use nothing but the numbered excerpts. Name the excerpt behind every statement as [n]. If they hold no answer, reply with: {REFUSAL}"
JUDGE = "List the answer's claims, one a line, each starting with SUPPORTED or UNSUPPORTED by the excerpts."
CONDENSE = "Write the follow-up as one question that needs no earlier turn."
TRANSFORMS = {
    "rewrite": "Write the question as one clear search query. Keep names, codes and numbers as they are.",
    "multi_query": "Write other phrasings of the question, one a line. Keep names, codes and numbers as they are.",
    "hyde": "Write a short passage that could answer the question.",
}


def index_files(files: DataFrame, index: Index, embedder, extractors=None, config: Config = DEFAULT, counter=None) -> tuple[int, DataFrame]:
    """Number of chunks added, and the failures(name, error, message).

    A document with a chunk that can't be embedded fails alone, where the embedder can give nulls for
    failures (models.or_null); others raise and change nothing.
    """
    documents, pages, failures = load(files, extractors, config)
    chunks = stage(chunk_table(documents, pages, embedder if config.semantic_chunking else None, config, counter), "chunks")
    rows = stage(chunks.withColumn("vector", or_null(embedder).embed(F.col("chunk_text"))), "embedded")
    broken = rows.where(F.col("vector").isNull()).select("doc_id", "source_file").distinct()
    good = stage(rows.join(broken.select("doc_id"), "doc_id", "left_anti").select(*rows.columns), "embeddable")
    lost = broken.select(
        F.col("source_file").alias("name"),
        F.lit("EmbeddingError").alias("error"),
        F.lit("its chunks could not be embedded").alias("message"),
    )
    return index.add_embedded(good), stage(failures.unionByName(lost), "failures")


def index_batch(files: DataFrame, index: Index, embedder, extractors=None, config: Config = DEFAULT, counter=None) -> DataFrame:
    """One row per uploaded name: name, n_chunks (null if skipped), error, message."""
    files = stage(files, "uploads")
    _, failures = index_files(files, index, embedder, extractors, config, counter)
    own = files.select("name", document_id(F.col("name"), F.col("content")).alias("doc_id")).distinct()
    done = own.join(chunk_counts(index.chunks), "doc_id").groupBy("name").agg(F.sum("n_chunks").alias("n_chunks"))
    failed = failures.groupBy("name").agg(F.max(F.struct("error", "message")).alias("f"))
    return own.select("name").distinct().join(done, "name", "left").join(failed, "name", "left").select(
        "name", F.when(F.col("f").isNull(), F.col("n_chunks")).alias("n_chunks"), "f.error", "f.message"
    )


#: Roots that this session has looked at.
_bootstrapped: set[str] = set()


def bootstrap(index: Index, folder: str, embedder, config: Config = DEFAULT, extractors=None) -> int:
    """Indexes a folder's supported files, once a session, if the index is empty.

    Chunks are numbered by file name (Index.add_embedded), so files need no order of their own.
    """
    if not config.bootstrap or index.root in _bootstrapped:
        return 0
    _bootstrapped.add(index.root)
    if not index.is_empty():
        return 0
    files = scan_files(index.spark, folder, glob="*.{" + ",".join(x[1:] + "," + x[1:].upper() for x in SUPPORTED) + "}")
    return index_files(files, index, embedder, extractors, config)[0]


def condense(questions: DataFrame, turns: DataFrame | None, chat, config: Config = DEFAULT) -> DataFrame:
    """questions(query_id, question, conv_id) with standalone: only follow-ups with a history are asked about."""
    if turns is None or chat is None:
        return questions.withColumn("standalone", squeeze(F.col("question")))
    prompts = conversation_prompt(turns, questions.select("conv_id", "question"), config)
    past = turns.select("conv_id").distinct().withColumn("_past", F.lit(True))
    rows = questions.join(past, "conv_id", "left").join(prompts, "conv_id", "left")
    ask = F.when(F.coalesce("_past", F.lit(False)) & needs_condensing(F.col("question"), config), F.col("prompt"))
    reply = F.get(F.filter(F.split(chat_udf(chat, CONDENSE)(ask), "\n"), lambda x: F.trim(x) != ""), 0)
    return rows.withColumn("standalone", F.coalesce(F.trim(reply), squeeze(F.col("question")))).drop("_past", "prompt")


def answer(
    questions: DataFrame,
    index: Index,
    embedder,
    chat=None,
    judge=None,
    scorer=None,
    turns: DataFrame | None = None,
    mode: str | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """One row per question: answer, citations, score, method, confidence, mode, counts.

    questions(query_id long, question[, conv_id]). Blank questions are rejected. Retrieval of all
    questions and phrasings is one plan; models are asked between plans. A judge's reply that the token
    limit cut off isn't counted: the overlap score stands in.
    """
    if not questions.where(~F.col("question").rlike(r"\S") | F.col("question").isNull()).isEmpty():
        raise ValueError("a question must not be empty")
    mode = mode or config.query_transform
    asked = condense(
        questions if "conv_id" in questions.columns else questions.withColumn("conv_id", F.lit(None).cast("long")),
        turns,
        chat,
        config,
    )
    asked = stage(asked, "questions")  # models are asked once, whatever reads their replies
    reply = chat_udf(chat, TRANSFORMS[mode])(F.col("standalone")) if chat is not None and mode in TRANSFORMS else F.lit(None).cast("string")
    texts = stage(
        search_texts(
            stage(
                asked.select(
                    "query_id", F.col("standalone").alias("question"), F.lit(mode).alias("mode"), reply.alias("reply")
                ),
                "replies",
            ),
            config,
        ),
        "search-texts",
    )
    vectors = index.vectors.join(index.chunks.select("chunk_id", "ord"), "chunk_id").select(F.col("ord").alias("chunk_id"), "ord", "vector")
    dense = texts.where("side = 'dense'").select("query_id", "variant_no", embedder.embed(F.col("text")).alias("vector"))
    found = hybrid_search(
        stage(dense, "query-vectors"),
        texts.where("side = 'sparse'").select("query_id", "variant_no", "text"),
        vectors,
        index.keywords,
        config=config,
    ).withColumnRenamed("chunk_id", "ord")
    found = stage(found, "candidates")
    body = found.join(index.chunks, "ord").join(asked.select("query_id", F.col("standalone").alias("question")), "query_id")
    kept = rerank(body.withColumnRenamed("chunk_text", "text"), scorer, config=config).withColumnRenamed("text", "chunk_text")
    context = stage(
        context_budget(
            kept.drop("rank").withColumnRenamed("final_rank", "rank"), config
        ).withColumn("marker", F.col("rank")),
        "context",
    )
    gathered = context.groupBy("query_id").agg(F.count("*").alias("n_context"), F.collect_list("chunk_text").alias("context"))
    rows = asked.join(gathered, "query_id", "left").join(
        format_context(context).withColumnRenamed("context", "excerpts"), "query_id", "left"
    )
    rows = rows.join(found.groupBy("query_id").agg(F.count("*").alias("retrieved_k")), "query_id", "left").join(
        texts.select("query_id", F.col("mode").alias("used_mode")).distinct(), "query_id", "left"
    )
    rows = rows.fillna(0, ["n_context", "retrieved_k"]).withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    prompt = F.when(F.col("n_context") > 0, F.concat_ws("\n\n", "excerpts", "standalone"))
    said = chat_udf(chat, ANSWER, "raise")(prompt) if chat is not None else F.lit(None).cast("string")
    rows = rows.withColumn("answer", normalize_citations(F.coalesce(F.nullif(F.trim(said), F.lit("")), F.lit(REFUSAL))))
    rows = stage(rows, "answers")
    verdict = chat_udf(judge, JUDGE, whole=True)(
        F.concat_ws("\n\n", "answer", "excerpts")
    ) if judge is not None else F.lit(None).cast("string")
    done = stage(grounding(stage(rows.withColumn("reply", verdict), "verdicts"), config), "grounded")
    cites = mark_citations(context, done.select("query_id", F.col("final_answer").alias("answer")))
    listed = cites.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "marker",
                    "source_file",
                    "doc_id",
                    "page_number",
                    "section_header",
                    "cited",
                    F.col("chunk_text").alias("snippet"),
                )
            )
        ).alias("citations")
    )
    return done.join(listed, "query_id", "left").select(
        "query_id",
        "question",
        F.nullif("standalone", "question").alias("standalone_question"),
        F.col("final_answer").alias("answer"),
        "citations",
        F.col("score").alias("faithfulness_score"),
        F.col("method").alias("grounding_method"),
        "confidence",
        F.col("used_mode").alias("used_query_transform"),
        "retrieved_k",
        F.col("n_context").alias("final_k"),
    )
