import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = pipeline.saved(out, name)
        left = [r[0] for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids, name
        ids = set(left)
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == ids
    assert pipeline.run(spark, SF).columns == last.columns


def test_odd(spark, odd):
    """Columns with the names of the stages' own results and helpers, and names with dots, come through with their values."""
    docs = odd.selectExpr("*", "'u' as keep", "7.5D as lines_removed", "lang as source", "doc_id as `a.b`", "'x' as __lines", "1 as doc1", "2 as k1", "3 as text_", "4 as root")
    docs = docs.unionByName(docs.limit(0))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        for r in rows:
            assert (r["keep"], r["lines_removed"], r["__lines"], r["doc1"], r["k1"], r["text_"], r["root"]) == ("u", 7.5, "x", 1, 2, 3, 4), name
            assert r["a.b"] == r["doc_id"] and r["score"] in ("k", "x", None), name
        if name == "quality":
            assert all((r["text"] or "").strip() for r in rows)
    assert stage_count(spark, docs) == docs.count()


def stage_count(spark, docs):
    return pipeline.pack(spark, docs, SF).filter("start = 0").count()


def test_empty(spark, none):
    docs = none
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF) if "text" in docs.columns else docs
    assert docs.count() == 0


def test_quality_has_all_columns_but_its_own(spark, odd):
    from linemill.llm.quality import quality

    out = quality(odd.withColumn("a.b", odd["doc_id"]))
    assert out.columns == ["doc_id", "text", "n_chars", "lang", "a.b", "score", "keep"] and dict(out.dtypes)["score"] == "double"
