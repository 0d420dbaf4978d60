"""The pipeline's stages against brute force, on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from sparkloom.plans.tables import table


def _run(spark, sf, tmp_path):
    docs, out = table(spark, sf, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    return out


def test_stages(spark, sf, tmp_path):
    before = table(spark, sf, "documents")
    quality, lines, near, clean, packed = _run(spark, sf, tmp_path)
    for df in (quality, lines, near, clean):
        assert df.columns == before.columns
        assert all(r.n_chars == len(r.text or "") for r in df.collect())
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in quality.collect()}
    fair = [d for d, label in labels.items() if label == (1, 0)]
    poor = [d for d, label in labels.items() if label != (1, 0)]
    assert sum(d in kept for d in fair) >= 0.97 * len(fair) and sum(d in kept for d in poor) <= 0.4 * len(poor)
    assert {r.doc_id for r in near.collect()} <= {r.doc_id for r in lines.collect()} <= kept

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {tuple(w[k:k + 10]) for r in table(spark, sf, "benchmark").collect() for w in [words(r.text)] for k in range(len(w) - 9)}
    assert not any(tuple(w[k:k + 10]) in windows for r in clean.collect() for w in [words(r.text)] for k in range(len(w) - 9))
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}
    per_doc = Counter()
    for r in pieces:
        per_doc[r.doc_id] += r.length
    assert all(per_doc[r.doc_id] == r.doc_tokens for r in pieces)


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, sf).count() == 0


def test_line_dedup_stage_cuts_long_passages_of_one_line(spark, sf):
    passage = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "a\n" + passage, 0), (2, passage + "\nb", 0), (3, passage, 0)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, sf).collect()} == {1: "a\n" + passage, 2: "b"}


def test_near_dedup_stage_links_from_080(spark, sf):
    """Shares of common 5-word shingles: 81 of 100 of the first two, 78 of 102 of the first and third."""
    def text(n, common, own):
        return " ".join([f"{own}w{k}" if k >= common + 4 else f"w{k}" for k in range(n + 4)])

    docs = spark.createDataFrame([(1, text(90, 90, "a")), (2, text(91, 81, "b")), (3, text(90, 78, "c"))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()} == {1, 3}


def test_quality_stage_without_labels_keeps_all(spark, sf, tmp_path):
    table(spark, sf, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 7), (None, None, None, None, 0, 7), (1, "a b", "en", "s", 3, 7), (2, "", "en", "s", 0, 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int")
    got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), sf).count() == 0


def test_stages_keep_nulls_repeats_and_extra_columns(spark, sf):
    rows = [(1, "some words here", "en", "s", 15, 7), (None, None, None, None, 0, 8), (1, "some words here", "en", "s", 15, 7), (2, "", "en", "s", 0, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __at int")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and {(r.doc_id, r["__at"]) for r in got.collect()} == {(1, 7), (None, 8), (2, 9)}
