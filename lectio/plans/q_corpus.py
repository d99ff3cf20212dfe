"""Queries over the driver's tables, whole tables always, each with its DuckDB equivalent.

Conventions for operators that need what the tables lack: the documents of one `source` are the
pages of one document (in doc_id order), a document is a chunk, and vector number n belongs to
document (or benchmark item) number n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, clean, outline, retrieval, segment
from ..sources import store
from ..sources.files import read_table
from ..sources.staging import stage

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), number.alias("page_number"), "text")


PAGES = "pg AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, text FROM documents)"
WORD, TOKEN = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# ------------------------------------------------------------------ text


@query(f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)
""")
def q_tokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens FROM documents")
def q_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"))


SENTENCES = r"""s0 AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*\s+|\n{2,})', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
), s1 AS (SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS sentence FROM s0
), s2 AS (SELECT doc_id, n, sentence, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s1
), sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, start, start + length(sentence) AS stop, sentence FROM s2 WHERE regexp_matches(sentence, '\S'))"""


def _sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = docs.select("doc_id", F.lit(0).alias("section_index"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return segment.sentence_spans(whole, docs)


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, md5(sentence) AS digest FROM sentences")
def q_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).select(
        "doc_id", *_long("i", "start"), F.col("end").cast("long").alias("stop"), F.md5("sentence").alias("digest")
    )


@query(rf"""
WITH RECURSIVE {SENTENCES}, n AS MATERIALIZED (SELECT doc_id, i, len(regexp_extract_all(sentence, '{TOKEN}')) AS n FROM sentences),
w AS MATERIALIZED (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id) <= 512 AS whole FROM n),
p(doc_id, i, size, pack, hard) AS (
  SELECT doc_id, i, CAST(n AS BIGINT), CAST(0 AS BIGINT), NOT whole AND n > 512 FROM w WHERE i = 0
  UNION ALL SELECT w.doc_id, w.i, CASE WHEN NOT whole AND (n > 512 OR hard OR size + n > 512) THEN 0 ELSE size END + n, pack + CAST(NOT whole AND (n > 512 OR hard OR size + n > 512) AS BIGINT), NOT whole AND n > 512
  FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1)
SELECT doc_id, i, pack, hard FROM p
""")
def q_packing_corpus(spark, sf_dir):
    """Every document as one section of one topic: the token bounds alone cut it."""
    rows = _sentences(spark, sf_dir).withColumn("topic", F.lit(0))
    return segment.pack_sentences(rows, ["doc_id", "section_index"]).select("doc_id", *_long("i", "pack"), "hard")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '[ \t]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM c)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM d
""")
def q_normalize_ws(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""
SELECT doc_id, CASE WHEN len(w) = 0 THEN false ELSE len(list_filter(w, lambda x: length(x) > 15)) > CAST(0.08 AS DOUBLE) * len(w) END AS together
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
""")
def q_run_together(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.words_ran_together(F.col("text")).alias("together"))


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(source || ' ' || lang || '.v1.txt', '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(text), 1, 8) AS name_id
FROM documents
""")
def q_doc_id(spark, sf_dir):
    name = F.concat("source", F.lit(" "), "lang", F.lit(".v1.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", X.document_id(name, F.col("text")).alias("name_id"))


FOLLOW_UP = r"""
SELECT conv_id, turn, len(w) > 0 AND (list_contains(string_split('""" + " ".join(X.CONTINUATIONS) + r"""', ' '), w[1]) OR len(w) <= 4 OR len(list_intersect(w, string_split('""" + " ".join(X.REFERRING_WORDS) + r"""', ' '))) > 0) AS follows
FROM (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> ''), lambda x: lower(trim(x, '.,!?;:'))) AS w FROM conversations)
"""


@query(FOLLOW_UP)
def q_needs_condensing(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.needs_condensing(F.col("text")).alias("follows"))


# ------------------------------------------------------------------ pages


@query(f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages FROM pg WHERE regexp_matches(text, '\\S') GROUP BY doc_id")
def q_nonblank(spark, sf_dir):
    return clean.nonblank(_pages(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_pages"))


@query(f"""
WITH {PAGES}, l AS (SELECT doc_id, page_number, unnest(range(len(p))) AS n, unnest(p) AS line FROM (SELECT *, string_split(text, chr(10)) AS p FROM pg))
SELECT doc_id, page_number, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(regexp_extract(line, '^\\s*')) AS start FROM l
""")
def q_line_offsets(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.struct("doc_id", "page_number").alias("doc_id"), "text")
    return outline.line_offsets(pages).select(
        "doc_id.doc_id", F.col("doc_id.page_number").cast("long").alias("page_number"), *_long("n", "start")
    )


RECURRENCE = PAGES + r""", ln AS (SELECT doc_id, page_number, regexp_replace(lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g'))), '[ \t]+', ' ', 'g') AS k FROM pg),
mk AS (SELECT DISTINCT doc_id, page_number, CASE WHEN regexp_matches(k, '^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') THEN '#' ELSE regexp_replace(k, '\p{Nd}+', '#', 'g') END AS key FROM ln WHERE k <> '')"""


@query(f"WITH {RECURRENCE} SELECT doc_id, md5(key) AS key, count(*) AS pages_with FROM mk GROUP BY ALL")
def q_line_recurrence(spark, sf_dir):
    return clean.line_recurrence(_pages(spark, sf_dir)).select("doc_id", F.md5("key").alias("key"), "pages_with")


@query(rf"""
WITH {PAGES}, t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'))) AS t FROM pg), v AS (SELECT DISTINCT doc_id, t FROM t WHERE regexp_full_match(t, '[a-z]{{2,}}|[a-z]+-[a-z]+'))
SELECT doc_id, count(*) FILTER (NOT contains(t, '-')) AS n_words, count(*) FILTER (contains(t, '-')) AS n_pairs, md5(string_agg(t, ',' ORDER BY t)) AS digest FROM v GROUP BY doc_id
""")
def q_vocabulary_corpus(spark, sf_dir):
    """What each source writes: its words and hyphenated pairs."""
    found = clean.vocabulary(_pages(spark, sf_dir))
    every = F.array_sort(F.concat("words", "pairs"))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("pairs").cast("long").alias("n_pairs"),
        F.md5(F.array_join(every, ",")).alias("digest"),
    ).where("n_words + n_pairs > 0")


@query(f"WITH {PAGES} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY page_number)) AS digest, count(*) AS page_count FROM pg GROUP BY doc_id")
def q_document_text(spark, sf_dir):
    return clean.document_text(_pages(spark, sf_dir)).select(
        "doc_id", F.md5("text").alias("digest"), F.col("page_count").cast("long").alias("page_count")
    )


@query(f"""
WITH {PAGES}, p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pg)
SELECT doc_id, page_number, start, start + length(text) AS stop FROM p
""")
def q_page_spans(spark, sf_dir):
    return clean.page_spans(_pages(spark, sf_dir)).select("doc_id", *_long("page_number", "start"), F.col("end").cast("long").alias("stop"))


# ------------------------------------------------------------------ search

STATS = f"""
tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE)) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25 = f"""{STATS},
ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(t) / (SELECT avg_len FROM n)))), 9) AS score
  FROM ask JOIN idf USING (term) JOIN tf USING (term) JOIN tok USING (doc_id) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20)"""
DENSE = """
vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dn AS (SELECT item_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 9) AS score FROM benchmark JOIN vec q ON q.vec_id = item_id CROSS JOIN vec c),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= 20)"""
RANKINGS = f"{BM25}, {DENSE}, r AS (SELECT 'dense' AS side, * FROM dense UNION ALL SELECT 'sparse', * FROM sparse)"
MERGED = """m AS (SELECT query_id, chunk_id, max(greatest(0, score)) FILTER (side = 'dense') AS d, max(greatest(0, score)) FILTER (side = 'sparse') AS s,
  min((CASE WHEN side = 'dense' THEN 0 ELSE 1 END) * 1000 + rank) AS seen, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS rrf FROM r GROUP BY query_id, chunk_id)"""
WEIGHTED = """b AS (SELECT *, min(d) OVER q AS dl, max(d) OVER q AS dh, min(s) OVER q AS sl, max(s) OVER q AS sh FROM m WINDOW q AS (PARTITION BY query_id)),
wf AS (SELECT query_id, chunk_id, round(CAST(0.5 AS DOUBLE) * coalesce(CASE WHEN d IS NULL THEN NULL WHEN dl = dh THEN 1 ELSE (d - dl) / (dh - dl) END, 0) + CAST(0.5 AS DOUBLE) * coalesce(CASE WHEN s IS NULL THEN NULL WHEN sl = sh THEN 1 ELSE (s - sl) / (sh - sl) END, 0), 9) AS f FROM b)"""


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "text")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant_no"), "text")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("vec_id").alias("ord"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


def _asked_vectors(spark, sf_dir):
    return _questions(spark, sf_dir).join(
        _vectors(spark, sf_dir), F.col("query_id") == F.col("chunk_id")
    ).select("query_id", "variant_no", "vector")


def _rankings(spark, sf_dir):
    keys = ["query_id", "chunk_id", "score", "rank"]
    dense = retrieval.dense_search(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)).select(
        F.lit("dense").alias("side"), F.lit(0).alias("variant_no"), *keys
    )
    sparse = retrieval.bm25_search(_questions(spark, sf_dir), _chunks(spark, sf_dir)).select(
        F.lit("sparse").alias("side"), F.lit(0).alias("variant_no"), *keys
    )
    return dense.unionByName(sparse)


@query(f"WITH {STATS} SELECT md5(term) AS term, df, round(idf, 6) AS idf FROM idf")
def q_bm25_stats(spark, sf_dir):
    return retrieval.term_stats(_chunks(spark, sf_dir)).select(F.md5("term").alias("term"), "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM sparse")
def q_bm25_topk(spark, sf_dir):
    return retrieval.bm25_search(_questions(spark, sf_dir), _chunks(spark, sf_dir)).select(
        "query_id", *_long("rank"), "chunk_id", F.round("score", 6).alias("score")
    )


@query(f"WITH {DENSE} SELECT query_id, rank, chunk_id, round(greatest(0, least(1, score)), 6) AS score FROM dense")
def q_dense_topk(spark, sf_dir):
    return retrieval.dense_search(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)).select(
        "query_id", *_long("rank"), "chunk_id", retrieval.shown_similarity(F.col("score")).alias("score")
    )


@query(f"WITH {RANKINGS}, {MERGED} SELECT query_id, chunk_id, round(rrf, 6) AS fused FROM m")
def q_rrf(spark, sf_dir):
    return retrieval.reciprocal_rank_fusion(_rankings(spark, sf_dir)).select(
        "query_id", "chunk_id", F.round("fused_score", 6).alias("fused")
    )


@query(f"WITH {RANKINGS}, {MERGED} SELECT query_id, chunk_id, round(d, 6) AS dense_score, round(s, 6) AS bm25_score FROM m")
def q_hybrid_merge(spark, sf_dir):
    return retrieval.merge_candidates(_rankings(spark, sf_dir)).select(
        "query_id",
        "chunk_id",
        F.round("dense_score", 6).alias("dense_score"),
        F.round("bm25_score", 6).alias("bm25_score"),
    )


@query(f"WITH {RANKINGS}, {MERGED}, {WEIGHTED} SELECT query_id, chunk_id, round(f, 6) AS fused FROM wf")
def q_weighted_fusion(spark, sf_dir):
    return retrieval.weighted_fusion(_rankings(spark, sf_dir)).select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused"))


@query(f"WITH {RANKINGS}, {MERGED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id) AS rank, chunk_id, round(rrf, 6) AS fused FROM m QUALIFY rank <= 20")
def q_hybrid_topk(spark, sf_dir):
    found = retrieval.hybrid_search(
        _asked_vectors(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir), _chunks(spark, sf_dir)
    )
    return found.select("query_id", *_long("rank"), "chunk_id", F.round("fused_score", 6).alias("fused"))


CONTENT = rf"""list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(%s, '\[\d+(?:\s*,\s*\d+)*\]', ' ', 'g')), '{WORD}'), lambda x: NOT list_contains(string_split('{" ".join(X.FUNCTION_WORDS)}', ' '), x)))"""


@query(f"""
WITH {RANKINGS}, {MERGED}, top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id) AS rank, chunk_id FROM m QUALIFY rank <= 20),
w AS (SELECT query_id, rank, chunk_id, {CONTENT % "q.text"} AS a, {CONTENT % "d.text"} AS c FROM top JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
s AS (SELECT query_id, rank, chunk_id, round(1 / (1 + exp(-(8 * (len(list_intersect(a, c)) / CAST(greatest(1, len(a)) AS DOUBLE)) - 4))), 9) AS score FROM w)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS final_rank, chunk_id, round(score, 6) AS score FROM s QUALIFY final_rank <= 5
""")
def q_rerank(spark, sf_dir):
    """The pair scorer is a stand-in (shared content words)."""
    from ..models import LexicalScorer

    found = retrieval.hybrid_search(
        _asked_vectors(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir), _chunks(spark, sf_dir)
    )
    rows = retrieval.with_texts(found, _chunks(spark, sf_dir)).join(
        _questions(spark, sf_dir).select("query_id", F.col("text").alias("question")), "query_id"
    )
    return retrieval.rerank(rows, LexicalScorer()).select(
        "query_id", *_long("final_rank"), "chunk_id", F.round("rerank_score", 6).alias("score")
    )


@query(f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM sparse")
def q_bm25_stored(spark, sf_dir):
    """As q_bm25_topk, from postings, term statistics and totals that are written first."""
    chunks = _chunks(spark, sf_dir)
    lists = stage(retrieval.postings(retrieval.token_table(chunks)).sortWithinPartitions("term"), "postings")
    n = chunks.agg(F.count("*").alias("n"), F.count("text").alias("texts"))
    mean = F.when(F.col("texts") > 0, F.coalesce("total", F.lit(0)) / F.nullif("texts", F.lit(0))).otherwise(0.0)
    totals = stage(n.crossJoin(F.broadcast(lists.agg(F.sum("tf").alias("total")))).select("n", mean.alias("avg_len")), "totals")
    terms = stage(retrieval.idf(lists.groupBy("term").agg(F.count("*").alias("df")), totals.select("n")), "terms")
    found = retrieval.KeywordIndex(lists, terms, totals).search(_questions(spark, sf_dir))
    return found.select("query_id", *_long("rank"), "chunk_id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ vectors


@query("""
SELECT vec_id, round(sum(x / nrm), 6) + 0.0::DOUBLE AS total, round(sum((x / nrm) * (x / nrm)), 6) AS square
FROM (SELECT vec_id, unnest(v) AS x, sqrt(list_inner_product(v, v)) AS nrm FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)) GROUP BY vec_id
""")
def q_l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", X.l2_normalize(F.col("embedding")).alias("v"))
    return rows.select(
        "vec_id",
        (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("total"),
        F.round(X.dot(F.col("v"), F.col("v")), 6).alias("square"),
    )


@query("SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS p FROM embeddings")
def q_sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.sigmoid(F.get("embedding", 0).cast("double")), 6).alias("p"))


TOPICS = """
v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT label, vec_id, round(1 - list_inner_product(v, lead(v) OVER w), 9) AS dist FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
p AS (SELECT label, round(quantile_cont(dist, 0.9), 9) AS edge FROM d GROUP BY label),
c AS (SELECT label, vec_id, dist, edge, coalesce(CAST(lag(dist) OVER (PARTITION BY label ORDER BY vec_id) > edge AS INTEGER), 0) AS cut FROM d JOIN p USING (label))"""


def _distances(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return segment.neighbour_distance(rows, ["label"], "vec_id").drop("vector")


@query(f"WITH {TOPICS} SELECT label, round(edge, 6) AS edge, count(*) AS n FROM c GROUP BY ALL")
def q_topic_threshold(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("label").agg(
        F.round(F.percentile("dist", F.lit(0.9)), 6).alias("edge"), F.count("*").alias("n")
    )


@query(f"WITH {TOPICS} SELECT label, vec_id, CAST(sum(cut) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS topic FROM c")
def q_topic_groups(spark, sf_dir):
    return segment.topic_groups(_distances(spark, sf_dir), ["label"], "vec_id").select("label", "vec_id", *_long("topic"))


# ------------------------------------------------------------------ the index


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("doc_id"),
        F.concat("lang", F.lit(".txt")).alias("source_file"),
        F.length("text").cast("long").alias("n_chars"),
        F.col("doc_id").alias("ord"),
    )


OLD = "ix AS (SELECT doc_id AS chunk_id, source AS doc_id, lang || '.txt' AS source_file, length(text) AS n_chars, doc_id AS ord FROM documents)"


@query(f"""WITH {OLD}, nw AS (SELECT chunk_id + 50 AS chunk_id, doc_id, 'new.txt' AS source_file, n_chars + 1 AS n_chars, ord FROM ix)
SELECT chunk_id, doc_id, source_file, n_chars, ord FROM ix WHERE chunk_id NOT IN (SELECT chunk_id FROM nw)
UNION ALL SELECT chunk_id, nw.doc_id, nw.source_file, nw.n_chars, coalesce(ix.ord, nw.ord + (SELECT max(ord) + 1 FROM ix)) FROM nw LEFT JOIN ix USING (chunk_id)""")
def q_upsert(spark, sf_dir):
    old = _index(spark, sf_dir)
    new = old.withColumns({"chunk_id": F.col("chunk_id") + 50, "source_file": F.lit("new.txt"), "n_chars": F.col("n_chars") + 1})
    return store.upsert(old, new)


@query(f"WITH {OLD} SELECT chunk_id, doc_id FROM ix WHERE doc_id NOT IN ('src1', 'src7')")
def q_delete_document(spark, sf_dir):
    return store.delete_documents(_index(spark, sf_dir), ["src1", "src7"]).select("chunk_id", "doc_id")


@query(f"""WITH {OLD} SELECT chunk_id, 'vectors' AS missing_in FROM ix WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'chunks' FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM ix)""")
def q_index_consistency(spark, sf_dir):
    return store.inconsistencies(_index(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"))


@query(f"WITH {OLD} SELECT doc_id, arg_max(source_file, ord) AS source_file FROM ix GROUP BY doc_id")
def q_indexed_documents(spark, sf_dir):
    return store.indexed_documents(_index(spark, sf_dir)).orderBy("source_file", "doc_id")


@query(f"WITH {OLD} SELECT doc_id, count(*) AS n_chunks FROM ix GROUP BY doc_id")
def q_chunk_counts(spark, sf_dir):
    return store.chunk_counts(_index(spark, sf_dir))


@query(f"WITH {OLD} SELECT chunk_id, doc_id, CASE WHEN chunk_id % 3 = 0 THEN NULL ELSE source_file END AS source_file, n_chars FROM ix")
def q_metadata_roundtrip(spark, sf_dir):
    rows = _index(spark, sf_dir).withColumn("source_file", F.when(F.col("chunk_id") % 3 != 0, F.col("source_file")))
    return store.from_metadata(store.to_metadata(rows), {"doc_id": "string", "source_file": "string", "n_chars": "long"})


@query(f"WITH {RANKINGS}, {OLD} SELECT query_id, rank, chunk_id, ix.doc_id, n_chars FROM sparse JOIN ix USING (chunk_id)")
def q_lookup_chunk(spark, sf_dir):
    found = retrieval.bm25_search(_questions(spark, sf_dir), _chunks(spark, sf_dir)).select("query_id", *_long("rank"), "chunk_id")
    return found.join(_index(spark, sf_dir).select("chunk_id", "doc_id", "n_chars"), "chunk_id")


@query("SELECT doc_id, source || '_p0_s0_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def q_chunk_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select(
        "doc_id", segment.chunk_id(F.col("source"), F.lit(None).cast("int"), F.lit(0), n).alias("chunk_id")
    )


# ------------------------------------------------------------------ around the answer


def _ranked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(
        F.col("source").alias("query_id"),
        rank.alias("rank"),
        "doc_id",
        X.token_count(F.col("text")).alias("token_count"),
        "lang",
        "text",
    )


@query(f"""
WITH k AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents)
SELECT query_id, rank, doc_id, n AS token_count FROM (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM k) WHERE total <= 6000 OR rank = 1
""")
def q_context_budget(spark, sf_dir):
    return answer.context_budget(_ranked(spark, sf_dir)).select("query_id", *_long("rank"), "doc_id", *_long("token_count"))


@query("""
WITH k AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS marker, lang, text FROM documents)
SELECT query_id, md5(string_agg('[' || marker || '] ' || lang || '.txt, p.' || marker || CASE WHEN lang = 'en' THEN ', "Main"' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY marker)) AS digest FROM k GROUP BY query_id
""")
def q_format_context(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select(
        "query_id",
        F.col("rank").alias("marker"),
        F.concat("lang", F.lit(".txt")).alias("source_file"),
        F.col("rank").alias("page_number"),
        F.when(F.col("lang") == "en", "Main").alias("section_header"),
        F.col("text").alias("chunk_text"),
    )
    return answer.format_context(rows).select("query_id", F.md5("context").alias("digest"))


def _turns(spark, sf_dir):
    """A user's turn and the next turn of the conversation, if the assistant spoke it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_r"), F.lead("text").over(w).alias("answer")
    )
    return rows.where("role = 'user' and _r = 'assistant'").select(
        "conv_id", F.col("turn").alias("turn_no"), F.col("text").alias("question"), "answer"
    )


TURNS = "tn AS (SELECT * FROM (SELECT conv_id, turn AS turn_no, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"


@query(rf"""
WITH {TURNS}, f AS (SELECT conv_id, turn_no, question, regexp_replace(regexp_replace(answer, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS a FROM tn QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) <= 4)
SELECT conv_id, turn_no, 'Q: ' || question || chr(10) || 'A: ' || CASE WHEN length(a) > 300 THEN rtrim(substr(a, 1, 300)) || '…' ELSE a END AS line FROM f
""")
def q_history_window(spark, sf_dir):
    return answer.history_window(_turns(spark, sf_dir))


@query(rf"""
WITH {TURNS}, w AS (SELECT conv_id, turn_no, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(answer, '\[\d+(?:\s*,\s*\d+)*\]', ' ', 'g')), '{WORD}'), lambda x: NOT list_contains(string_split('{" ".join(X.FUNCTION_WORDS)}', ' '), x))) AS a, regexp_extract_all(lower(question), '{WORD}') AS q FROM tn)
SELECT conv_id, turn_no, round(CASE WHEN len(a) = 0 THEN 1 ELSE len(list_intersect(a, q)) / CAST(len(a) AS DOUBLE) END, 6) AS score FROM w
""")
def q_overlap_score(spark, sf_dir):
    return _turns(spark, sf_dir).select(
        "conv_id", "turn_no", F.round(answer.overlap_score(F.col("answer"), F.array("question")), 6).alias("score")
    )
