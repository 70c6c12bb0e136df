"""The pipeline's stages against plain versions, each on its own input."""

import brute
import corpus_pipeline as cp

from quarrystat.llm.queries import token_config


def test_pipeline(spark, sf, docs):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = docs
    for name, stage in cp.STAGES:
        full = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in now.collect()]
        before = [x[:2] for x in full]
        out = stage(spark, now, sf)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= {i for i, _ in before}
        if "quality" in name:
            assert all(brute.quality(r["text"])[0] >= 10 for r in rows)
        if "Jaccard" in name:
            assert set(ids) == {c for _, c, _ in brute.components(before, 5, 80, 100).values()}
        if "decontamination" in name:
            assert set(ids) == {i for i, x in brute.decontaminate(before, bench).items() if not x[1]}
        if "mixing" in name:
            assert set(ids) == set(brute.mixing(full, cp.MIX))
        if name == cp.STAGES[-1][0]:
            assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == brute.tokens(before, token_config().tokenizer)
        now = spark.createDataFrame(rows, out.schema)
    whole = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert whole == sorted(tuple(r) for r in rows)


def test_pipeline_keeps_texts_of_one_id(spark, sf, docs):
    """Two texts under one doc_id: the near-duplicate stage keeps both unless they are near copies of something."""
    r = docs.first()
    text = lambda p: " ".join(f"{p}{i}" for i in range(60)) + "."
    now = spark.createDataFrame([(9, text("a"), r["lang"], r["source"], 1), (9, text("b"), r["lang"], r["source"], 1), (4, text("b") + " more", r["lang"], r["source"], 1)], docs.schema)
    kept = dict(cp.STAGES)["n-gram Jaccard join"](spark, now, sf)
    assert sorted((x["doc_id"], x["text"]) for x in kept.collect()) == [(4, text("b") + " more"), (9, text("a"))]
