"""The pipeline's stages against plain versions of their decisions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lectio.llm import pii, quality, toxicity
from lectio.llm.common import held_out, read_table, stage


def test_pipeline(spark, sf_dir):
    from test_operators import check_packed, plain_links

    start = read_table(spark, sf_dir, "documents")
    docs, seen = start, []
    for name, step in P.STAGES:
        before = docs.collect()
        docs = stage(step(spark, docs, sf_dir), "test")
        seen.append((name, before, docs.collect(), docs.columns))
    assert [n for n, *_ in seen] == ["toxicity", "quality", "near-duplicates", "personal-data", "packing"]
    assert all(columns == start.columns for *_, columns in seen[:-1])

    labels = read_table(spark, sf_dir, "labels")
    _, before, after, _ = seen[0]
    score = toxicity.Scorer(toxicity.fit_toxicity(start, labels, ~held_out(*toxicity.FOLD))).scores([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score) if s < 0.5)
    _, before, after, _ = seen[1]
    score = quality.Scorer(quality.fit_quality(start, labels, ~held_out(*quality.FOLD))).scores([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score) if s >= 0.5)
    _, before, after, _ = seen[2]
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in plain_links([(r.doc_id, r.text) for r in before]) if i == c)
    _, before, after, _ = seen[3]
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == {r.doc_id: (pii.redact(r.text), len(pii.redact(r.text))) for r in before}
    _, before, after, _ = seen[4]
    check_packed(after, [(r.doc_id, r.text) for r in before])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in after)


def test_run_gives_the_last_stage(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.where(F.col("length") > 2048).count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_run_on_awkward_tables(spark, tmp_path, labelled):
    from test_operators import AWKWARD, check_packed, clashing, insult, toy

    bad = "Ndnt " * 30
    rows = AWKWARD + [(100 + i, t) for i, (t, _) in enumerate(toy(60, 3, insult))] + [
        (200 + i, bad + t) for i, (t, _) in enumerate(toy(30, 4, lambda rng, w: " ".join(w)))
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(
        {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i < 200), int(100 <= i < 200 and i % 2)) for i, _ in rows if i and i >= 100]
    spark.createDataFrame(marks if labelled else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    text = {r.doc_id for r in got}
    assert {1, 2, None} <= text and len([r for r in got if r.doc_id in (1, 2)]) == 2 and 4 not in text
    assert all(len(r.ids) == r.length for r in got) and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
