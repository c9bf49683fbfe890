from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_stages(spark):
    import corpus_pipeline
    from plumbline.llm import secrets
    from plumbline.llm.common import stored

    from .test_texts import brute_components, texts_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after, _ = stored(stage(spark, before, SF), name)
        if name != "tokens":
            assert after.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            kept = {r.doc_id for r in after.collect()}
            good = [r.doc_id for r in labels.filter("quality = 1").collect()]
            assert sum(i in kept for i in good) >= 0.95 * len(good) and len(kept) < docs.count()
        if name == "near_duplicates":
            groups = brute_components(texts_of(before), 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in groups.values()})
        if name == "secrets":
            assert after.count() == before.count()
            assert all(not s.spans for s in secrets.scan(after).collect())
        if name == "mixing":
            assert 0 < after.count() <= 2 * before.count()
        if name == "tokens":
            assert after.count() == before.count() and after.filter("n_tokens > 0").count() == after.count()
        before = after


def test_stages_on_odd_rows(spark, docs, empty):
    """Null ids, sources and texts, empty and repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    nameless = docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.unionByName(nameless).unionByName(nameless)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, SF), stage(spark, empty, SF)
        if name != "tokens":
            assert out.columns == none.columns == docs.columns
        assert none.count() == 0
        n = out.count()
        if name in ("secrets", "tokens"):
            assert n == odd.count()
        if name == "near_duplicates":
            rows = out.collect()
            assert len({(r.doc_id, r.text or "") for r in rows}) == n  # repeated rows once
            whole = {r.doc_id for r in rows}
            assert {0, 1, 2, 3}.issubset(whole)  # texts without words are no copies of others
            assert not {10, 11} & whole  # exact copies of 9
