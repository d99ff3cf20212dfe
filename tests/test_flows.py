"""Whole flows, degradation, storage, splits and streaming."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.config import Config, embedding_dimension
from lectio.functions import text as X
from lectio.models import EmbeddingError, ExtractiveChat, HashingEmbedder, LexicalScorer, PairModel, RankTokenCounter, RegexTokenCounter, Reply, RerankerUnavailable, VectorModel
from lectio.models import batched_embedding, get_chat, get_embedder, is_transient, register_embedder, with_retry
from lectio.operators import clean, outline, retrieval, segment
from lectio.plans.pipeline import answer, bootstrap, index_batch, index_files
from lectio.sources import files
from lectio.sources.staging import stage
from lectio.sources.store import History, Index, IndexProviderMismatch

GUIDE = b"1 Cats\nCats purr when they are calm. They sleep a lot.\n2 Dogs\nDogs bark at night. A dog guards the house.\n"
FISH = b"Fish swim in the sea. Herring move in large schools."


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = Index(spark, str(tmp_path_factory.mktemp("ix") / "store"), dimension=64)
    n, failed = index_files(files.from_bytes(spark, [("guide.txt", GUIDE), ("fish.md", FISH), ("x.docx", b"")]), at, HashingEmbedder(64))
    assert n == 3 and [r.name for r in failed.collect()] == ["x.docx"]
    return at


def test_chunks_reproduce_their_text(spark, index):
    docs, pages, _ = files.load(files.from_bytes(spark, [("guide.txt", GUIDE), ("fish.md", FISH)]))
    texts = clean.document_text(pages)
    rows = index.chunks.join(texts, "doc_id").collect()
    assert rows and all(r.text[r.char_start : r.char_end].strip() == r.chunk_text for r in rows)
    assert {r.section_header for r in rows} == {"1 Cats", "2 Dogs", None}


def test_upsert_is_idempotent_and_consistent(index, spark):
    before = index.chunks.orderBy("chunk_id").collect()
    index_files(files.from_bytes(spark, [("guide.txt", GUIDE)]), index, HashingEmbedder(64))
    assert index.chunks.orderBy("chunk_id").collect() == before and not index.needs_rebuild()


def test_provider_guard_and_reset(spark, index, tmp_path):
    with pytest.raises(IndexProviderMismatch):
        Index(spark, index.root, provider="other", dimension=768)
    other = Index(spark, str(tmp_path / "o"), dimension=64)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(FISH)
    assert other.is_empty() and bootstrap(other, str(tmp_path / "in"), HashingEmbedder(64)) == 1
    assert bootstrap(other, str(tmp_path / "in"), HashingEmbedder(64)) == 0
    out = str(tmp_path / "out")
    other.export_jsonl(out)
    assert other.import_jsonl(out).count() == 1
    bad = tmp_path / "bad.json"
    bad.write_text("{not json\n")
    assert other.import_jsonl(str(bad)).count() == 0
    other.delete(other.chunks.first().doc_id)
    assert other.is_empty()
    other.reset()
    assert other.is_empty()


def test_answers(spark, index):
    asked = spark.createDataFrame([(1, "When do cats purr?"), (2, "What do herring move in?")], "query_id long, question string")
    rows = {
        r.query_id: r for r in answer(
            asked, index, HashingEmbedder(64), ExtractiveChat(), scorer=LexicalScorer(), mode="none"
        ).collect()
    }
    assert rows[1].citations[0].cited and rows[1].grounding_method == "overlap" and rows[1].confidence in ("medium", "low")
    assert rows[1].final_k == len(rows[1].citations) and rows[1].used_query_transform == "none"


class Broken:
    def invoke(self, system, user):
        raise ConnectionError("down")

    def score(self, question, text):
        raise RerankerUnavailable("no model")

    def embed(self, text):
        raise EmbeddingError("no model")


def test_failing_models_degrade(spark, index):
    asked = spark.createDataFrame([(1, "When do cats purr?")], "query_id long, question string")
    row = answer(asked, index, HashingEmbedder(64), None, judge=Broken(), scorer=Broken(), mode="multi_query").first()
    assert row.used_query_transform == "none" and row.answer == X.REFUSAL and row.grounding_method is None
    texts = spark.createDataFrame([("d", "One two. Three four.")], "doc_id string, text string")
    parts = texts.select(
        "doc_id",
        F.lit(0).alias("section_index"),
        F.lit(None).cast("string").alias("header"),
        F.lit(0).alias("start"),
        F.length("text").alias("end"),
    )
    assert segment.semantic_spans(parts, texts, Broken()).count() == 1
    with pytest.raises(ValueError):
        answer(spark.createDataFrame([(1, "  ")], "query_id long, question string"), index, HashingEmbedder(64))
    with pytest.raises(ValueError):
        retrieval.fuse(None, "other")


def test_semantic_chunking_with_vectors(spark):
    body = ("Cats purr and sleep. " * 30 + "Stocks fell on Monday. " * 30).strip()
    texts = spark.createDataFrame([("d", body)], "doc_id string, text string")
    parts = texts.select(
        "doc_id",
        F.lit(0).alias("section_index"),
        F.lit(None).cast("string").alias("header"),
        F.lit(0).alias("start"),
        F.length("text").alias("end"),
    )
    spans = segment.semantic_spans(parts, texts, HashingEmbedder(64)).orderBy("n").collect()
    assert len(spans) >= 2 and spans[-1].end == len(body)


def test_character_pieces(spark):
    text = "para one\n\n" + "word " * 60 + "x" * 150
    row = spark.createDataFrame([(text,)], "t string").select(
        segment.char_pieces(F.col("t"), 100).alias("p"), segment.char_pieces(F.col("t"), 100, 20).alias("o")
    ).first()
    assert all(s.end - s.start <= 100 for s in [*row.p, *row.o])
    assert " ".join(text[s.start : s.end] for s in row.p).split() == text[:-51].split() + [text[-51:]]  # white space is left out, the long word cut once
    assert any(b.start < a.end for a, b in zip(row.o, row.o[1:])) and row.o[-1].end == len(text)


class Flaky:
    """Models that fail in a worker for texts with "poison"."""

    dimension = 8

    def __init__(self, on_error="raise"):
        self.on_error = on_error

    def or_null(self):
        return Flaky("null")

    def embed(self, text):
        def vectors(texts):
            if any("poison" in t for t in texts):
                raise ValueError("no vectors for this")
            return np.array([[len(t), *[t.count(c) for c in "aeioust"]] for t in texts], float)

        return batched_embedding(vectors, on_error=self.on_error)(text)


def test_failures_in_a_worker_stay_with_their_document(spark, tmp_path):
    texts = spark.createDataFrame(
        [("a", "One two. Three four. " * 60), ("b", "One poison. Three four. " * 60)], "doc_id string, text string"
    )
    parts = texts.select(
        "doc_id",
        F.lit(0).alias("section_index"),
        F.lit(None).cast("string").alias("header"),
        F.lit(0).alias("start"),
        F.length("text").alias("end"),
    )
    spans = segment.semantic_spans(parts, texts, Flaky()).collect()
    plain = segment.semantic_spans(parts, texts, None).collect()
    assert sorted((r.start, r.end) for r in spans if r.doc_id == "b") == sorted((r.start, r.end) for r in plain if r.doc_id == "b")
    at = Index(spark, str(tmp_path / "ix"), dimension=8)
    batch = files.from_bytes(spark, [("good.txt", FISH), ("bad.txt", b"This is poison."), ("x.docx", b"x"), ("blank.md", b" ")])
    got = {r.name: (r.n_chunks, r.error) for r in index_batch(batch, at, Flaky()).collect()}
    assert got == {
        "good.txt": (1, None),
        "bad.txt": (None, "EmbeddingError"),
        "x.docx": (None, "UnsupportedDocumentError"),
        "blank.md": (None, "EmptyDocumentError"),
    }
    assert at.count() == 1 and not at.needs_rebuild()


def test_pair_models(spark):
    rows = spark.createDataFrame(
        [(q, "ask", i, t, i) for q, t0 in ((1, "text"), (2, "poison")) for i, t in enumerate(["a", t0, "ccc"], 1)],
        "query_id long, question string, chunk_id long, text string, rank int",
    )

    def make():
        def predict(pairs):
            assert len(pairs) <= 2
            if any(t == "poison" for _, t in pairs):
                raise MemoryError("too much")
            return [len(t) for _, t in pairs]

        return predict

    got = retrieval.rerank(rows.coalesce(1), PairModel(make, Config(rerank_batch_size=2)), k=2).collect()
    assert {(r.query_id, r.final_rank, r.chunk_id) for r in got} == {(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 2)}
    assert all(r.rerank_score is None for r in got if r.query_id == 2) and round(got[0].rerank_score, 6) == round(1 / (1 + np.exp(-4)), 6)

    def missing():
        raise RerankerUnavailable("no model")

    assert [r.chunk_id for r in retrieval.rerank(rows, PairModel(missing), k=1).collect()] == [1, 1]


def test_judges_reply_that_was_cut_off(spark, index):
    class Judge:
        def __init__(self, reason):
            self.reason = reason

        def invoke(self, system, user):
            return Reply("SUPPORTED one", self.reason)

    asked = spark.createDataFrame([(1, "When do cats purr?")], "query_id long, question string")
    method = lambda reason: answer(
        asked, index, HashingEmbedder(64), ExtractiveChat(), judge=Judge(reason), mode="none"
    ).first().grounding_method
    assert (method("stop"), method("length")) == ("judge", "overlap")


def test_factories(spark):
    assert get_embedder("hashing") is get_embedder("hashing") and get_chat() is get_chat()
    assert get_chat("extractive", 100) is not get_chat("extractive", 200)
    for call in (lambda: get_embedder("nobody"), lambda: get_embedder("remote")):
        with pytest.raises(EmbeddingError):
            call()
    register_embedder("tiny", lambda c: VectorModel(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, c))
    row = spark.createDataFrame([("abc",)], "t string").select(get_embedder("tiny").embed(F.col("t")).alias("v")).first()
    assert np.allclose(row.v, [3 / 10**0.5, 1 / 10**0.5])
    local = get_embedder("local").or_null()  # the library is missing here: nulls
    assert spark.createDataFrame([("abc",)], "t string").select(local.embed(F.col("t")).alias("v")).first().v is None


def test_token_counters(spark):
    public = pytest.importorskip("public_tokenizers")
    counter = RankTokenCounter(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    text = "Unbelievable tokenisation happens here. " * 40
    rows = spark.createDataFrame([("d", 1, text)], "doc_id string, page_number int, text string")
    docs = spark.createDataFrame([("d", "d.txt")], "doc_id string, source_file string")
    by_words, by_ranks = (segment.chunk_table(docs, rows, counter=c).collect() for c in (RegexTokenCounter(), counter))
    assert sum(r.token_count for r in by_ranks) > sum(r.token_count for r in by_words)


def test_history(spark, tmp_path):
    past = History(spark, str(tmp_path / "h"))
    assert past.turns().count() == 0
    turns = lambda *rows: spark.createDataFrame(rows, "conv_id long, question string, answer string")
    past.append(turns((1, "a", "b"), (2, "c", "d")))
    past.append(turns((1, "e", "f")))
    assert sorted((r.conv_id, r.turn_no, r.question) for r in past.turns().collect()) == [(1, 1, "a"), (1, 2, "e"), (2, 1, "c")]
    past.clear(1)
    assert [r.conv_id for r in past.turns().collect()] == [2]
    past.append(turns((1, "g", "h")))
    assert sorted((r.conv_id, r.turn_no) for r in past.turns().collect()) == [(1, 1), (2, 1)]


def test_index_states(spark, tmp_path):
    at = Index(spark, str(tmp_path / "ix"), dimension=64, model="m1", config=Config(collection="c1"))
    many = [(f"f{i}.txt", f"Text number {i} about topic {i % 3}.".encode()) for i in range(12)]
    index_files(files.from_bytes(spark, many), at, HashingEmbedder(64))
    assert at.meta() == {"provider": "hashing", "dimension": 64, "model": "m1", "collection": "c1"}
    first = {r.chunk_id: r.ord for r in at.chunks.collect()}
    assert sorted(first.values()) == list(range(12))  # one number for each chunk, whatever its document
    before = at.chunks  # a reader at work
    index_files(files.from_bytes(spark, [("more.txt", b"Another text.")]), at, HashingEmbedder(64))
    assert before.count() == 12 and at.count() == 13 and {r.chunk_id: r.ord for r in at.chunks.collect()}.items() >= first.items()
    asked = spark.createDataFrame([(1, "Another topic")], "query_id long, text string")
    rows = at.chunks.select(F.col("ord").alias("chunk_id"), "ord", F.col("chunk_text").alias("text"))
    want = [tuple(r) for r in retrieval.bm25_search(asked, rows).orderBy("rank").collect()]
    assert want and [tuple(r) for r in retrieval.bm25_search(asked, at.keywords).orderBy("rank").collect()] == want
    at.delete(at.chunks.where("source_file = 'more.txt'").first().doc_id)
    assert at.count() == 12 and not at.needs_rebuild()
    out = tmp_path / "out.json"
    record = lambda **x: json.dumps({"chunk_id": "k", "doc_id": "d", "ord": 1, **x})
    out.write_text("\n".join([record(chunk_text="old", page_number=3), record(chunk_text="new")]))
    assert [(r.chunk_text, r.page_number) for r in at.import_jsonl(str(out)).collect()] == [("new", None)]


def test_dense_search_in_bands(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))]
    vectors = spark.createDataFrame(rows, "chunk_id long, ord long, vector array<double>")
    asked = vectors.select(F.struct("chunk_id", F.lit(2000).alias("variant")).alias("query_id"), "vector")
    one = sorted(map(repr, retrieval.dense_search(asked, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BAND", 7)
    assert one == sorted(map(repr, retrieval.dense_search(asked, vectors, 3).collect())) and len(one) == 180


def test_longest_chain():
    rng = random.Random(3)
    for _ in range(400):
        numbers = [tuple(rng.randrange(1, 6) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))]
        length, back = [], []
        for i, n in enumerate(numbers):
            before = [(length[j], -j) for j in range(i) if outline.follows(numbers[j], n)]
            top = max(before, default=(0, 1))
            length.append(top[0] + 1)
            back.append(-top[1])
        want, at = [], length.index(max(length)) if length else -1
        while at >= 0:
            want.append(at)
            at = back[at]
        assert outline.longest_chain(numbers) == want[::-1]


def test_section_counts(spark):
    parts = spark.createDataFrame([("d", 0, None), ("d", 1, "H"), ("e", 0, None)], "doc_id string, section_index int, header string")
    assert sorted(map(tuple, segment.section_counts(parts).collect())) == [("d", 2, 1), ("e", 1, 0)]


def test_bm25_on_one_chunk_finds_nothing(spark):
    chunks = spark.createDataFrame([(1, 1, "alpha beta")], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "")], "query_id long, text string")
    assert retrieval.bm25_search(asked, chunks).count() == 0


def test_bm25_moves_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n))
    chunks = spark.createDataFrame([(i, i, text(rng.randrange(1, 60))) for i in range(300)] + [(300, 300, None), (301, 301, "")], "chunk_id long, ord long, text string")
    chunks = chunks.repartition(3)
    asked = spark.createDataFrame([(q, text(5)) for q in range(9)] + [(9, "absent")], "query_id long, text string")
    tokens = {r.chunk_id: (r.text or "").split() for r in chunks.collect()}
    n, texts = len(tokens), len(tokens) - 1
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean, avg = sum(raw.values()) / len(raw), sum(map(len, tokens.values())) / texts
    weight = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    want = []
    for q in asked.collect():
        found = []
        for c, ts in tokens.items():
            tf = Counter(ts)
            s = sum(weight[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in q.text.split() if t in tf)
            if round(s, 9) > 0:
                found.append((-round(s, 9), c))
        want += [(q.query_id, c, i + 1) for i, (_, c) in enumerate(sorted(found)[:4])]
    stored = retrieval.token_table(chunks)
    lists = retrieval.postings(stored)
    df_of = lists.groupBy("term").agg(F.count("*").alias("df"))
    totals = retrieval.totals_of(stored)
    index = retrieval.KeywordIndex(lists, retrieval.idf(df_of, totals.select("n")), totals)
    for band in (2048, 4):  # of more questions than a band holds, each band is searched
        monkeypatch.setattr(retrieval, "QUERY_BAND", band)
        for source in (chunks, index):
            got = retrieval.bm25_search(asked, source, 4)
            assert sorted((r.query_id, r.chunk_id, r.rank) for r in got.collect()) == sorted(want)
    plan = retrieval.bm25_search(asked, chunks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))  # pairs used to be dealt by chunk


def test_search_writes_counts_not_tokens(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 50)))) for i in range(200)]
    chunks = spark.createDataFrame([*rows, (200, 200, None)], "chunk_id long, ord long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w2 w88"), (2, "w5 w7 absent")], "query_id long, text string")
    written = {}

    def kept(df, label="step"):
        written[label] = stage(df, label)
        return written[label]

    monkeypatch.setattr(retrieval, "stage", kept)
    want = sorted(map(repr, retrieval.bm25_search(asked, chunks, 4).collect()))
    assert len(want) == 8 and "tokens" not in {c for df in written.values() for c in df.columns}  # as large as the texts
    kept_terms = {t for r in written["counted-terms"].where("term IS NULL").collect() for t in r.terms}
    assert kept_terms == {"w1", "w2", "w88", "w5", "w7"}
    plain = {(r.term, r.df) for r in retrieval.term_stats(chunks).collect()}
    for bound in (1_000_000, 20):  # of more terms than a task holds, those that it has go on
        monkeypatch.setattr(retrieval, "VOCABULARY", bound)
        monkeypatch.setattr(retrieval, "ASKED_TERMS", bound // 10)  # of more asked terms, all are kept
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        try:
            assert sorted(map(repr, retrieval.bm25_search(asked, chunks, 4).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found = written["counted-terms"].where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
        assert {(r.term, r.df) for r in found.collect()} == plain
    assert written["counted-terms"].where("size(terms) > 5").count()


def test_rerank_reads_texts_where_they_are(spark, sf_dir, monkeypatch):
    from lectio.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["q_rerank"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin .*LeftSemi, BuildRight", plan)  # else every text is dealt by its id
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    chunks = spark.createDataFrame([(i % 40, f"text {i}") for i in range(60)] + [(None, "none")], "chunk_id long, text string")
    found = spark.createDataFrame([(q, c) for q in range(5) for c in range(q, 45, 3)] + [(9, None)], "query_id long, chunk_id long")
    want = sorted(map(repr, found.join(chunks, "chunk_id").collect()))
    for band in (500_000, 4):
        monkeypatch.setattr(retrieval, "TEXT_BAND", band)
        assert sorted(map(repr, retrieval.with_texts(found, chunks).collect())) == want


def _shuffled_rows(spark, run):
    """Rows that run() writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_weighted_fusion_moves_the_vocabulary_once(spark, sf_dir):
    from lectio.plans import catalog

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = documents.select(F.explode(F.array_distinct(retrieval.tokenize(F.col("text"))))).distinct().count()
    moved = _shuffled_rows(spark, lambda: catalog.QUERIES["q_weighted_fusion"](spark, sf_dir).collect())
    assert terms > 20_000 and terms <= moved < 1.7 * terms


def test_two_extractors(spark):
    class Pages:
        def __init__(self, *pages):
            self.texts = list(pages)

        def pages(self, content, name):
            if content == b"bad":
                raise OSError("damaged")
            return self.texts

    word = "Incomprehensibilities"
    got = files.load(
        files.from_bytes(spark, [("a.pdf", b"x"), ("b.pdf", b"bad")]),
        [Pages("all fine", f"{word} {word}"), Pages("other", "healthy page")],
    )
    assert sorted(r.text for r in got[1].collect()) == ["all fine", "healthy page"]
    assert [(r.name, r.error) for r in got[2].collect()] == [("b.pdf", "ExtractionError")]


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 from upstream")
        return "ok"

    waits = []
    assert with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(EmbeddingError):
        with_retry(lambda: 1 / 0, sleep=waits.append)
    assert is_transient(RuntimeError("Rate limit reached")) and not is_transient(ValueError("bad key"))


def test_config(monkeypatch):
    monkeypatch.setenv("LECTIO_K_FINAL", "7")
    config = Config.from_env({"k_retrieve": 9, "k_final": 3})
    assert (config.k_final, config.k_retrieve) == (7, 9)
    with pytest.raises(ValueError):
        embedding_dimension("nobody")


def test_streaming(spark, tmp_path):
    from lectio.streaming.ingest import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "f.txt").write_bytes(FISH)
    at = Index(spark, str(tmp_path / "store"), dimension=64)
    stream = watch(spark, str(folder), at, HashingEmbedder(64), str(tmp_path / "cp"))
    stream.awaitTermination(120)
    assert at.count() == 1 and json.dumps(at.chunks.first().asDict())
