"""The pipeline against the single operators' brute-force versions, stage by stage."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from estatelens.llm import langid
from estatelens.llm.common import id_residue, stored

from .test_corpus_operators import SF, brute_hits, brute_links


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "shards":
            assert docs.columns == columns
        if name == "near_copies":
            links = brute_links([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in kept[name]) == sorted(i for i, v in links.items() if v[1] == i)
        if name == "benchmark_passages":
            hits = dict(brute_hits([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))
            assert sorted(r.doc_id for r in kept[name]) == sorted(i for i, v in hits.items() if not v[4])
        if name == "language":
            rows = before.collect()
            names, scores = langid.learn_profiles(before.filter(id_residue(3) != 1)).predict([r.text or "" for r in rows])
            assert sorted(r.doc_id for r in kept[name]) == sorted(r.doc_id for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5)
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 3
    assert Counter(r.doc_id for r in kept["shards"]) == Counter(r.doc_id for r in kept["mixing"])
    sizes = Counter(r.shard for r in kept["shards"])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in kept["shards"])


def test_documents_without_labels_stay(spark):
    rows = [(1, "a clean text", None, "s", 12), (2, "ещё один текст", None, "s", 14), (3, "12 34 !", None, "s", 7), (4, "", None, "s", 0), (5, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_language_stage_selects(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r.doc_id: r.lang for r in docs.collect()}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "fr"))
    kept = [of[r.doc_id] for r in corpus_pipeline.language(spark, docs, SF).collect()]
    wanted = [x for x in of.values() if x in ("de", "fr")]
    assert sum(x in ("de", "fr") for x in kept) >= 0.95 * len(wanted) and sum(x not in ("de", "fr") for x in kept) <= 0.02 * len(of)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 0.999999)
    assert corpus_pipeline.language(spark, docs, SF).count() < len(kept)


def test_clashing_columns_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [f"__{x}" for x in ("language", "score", "lang", "id", "h", "k", "n", "again", "gone", "hits", "bad", "cut", "bucket", "order", "task", "at", "k2", "y")] + ["y", "t", "u", "b", "key", "row", "copies", "component", "slot"]
    docs = docs.unionByName(docs.limit(7)).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        want = columns if name != "shards" else [c for c in columns if c != "slot"] + ["shard", "slot"]
        assert docs.columns == want
        assert all(r[n] == i for r in docs.limit(3).collect() for i, n in enumerate(names) if n != "slot")
    assert docs.count() > 0
