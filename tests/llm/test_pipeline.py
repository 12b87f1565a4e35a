"""The pipeline against its operators by brute force, over the small tables."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark):
    from test_dedup import LOW
    from test_similar import estimated
    from test_text_joins import words

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 10, 0) + 1)}
    sizes = {len(x) for x in windows}
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = corpus_pipeline.new_path(spark, "test")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        got = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert got <= set(rows) and sum(1 for i in set(rows) - got if labels.get(i) == 0) <= 1
        elif name == "exact_dedup":
            best = {}
            for i, t in rows.items():
                best[k] = max(best.get(k := (t or "").translate(LOW), i), i)
            assert got == set(best.values())
        elif name == "simhash_near_dedup":
            ids = sorted(rows)
            root = estimated([rows[i] for i in ids])
            assert got == {ids[r] for r in root}
        elif name == "decontamination":
            clean = {i for i, t in rows.items() if not any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in sizes for p in range(len(w) - n + 1))}
            assert got == clean
        else:
            assert got == set(rows)
        if name != "best_fit_packing":
            assert out.columns == columns
            rows = {i: rows[i] for i in got}
        docs = out


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0 and out.count() > 0
