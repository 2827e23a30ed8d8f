"""The pipeline's stages against plain versions, on a small table with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from test_operators import words


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    fresh = lambda n: words(rng, n, 10**6)
    clean = [(k, "\n".join(fresh(25) for _ in range(6)), "en") for k in range(30)]
    long = fresh(400)
    near = " ".join([*long.split()[:-1], "changed"])
    passage = fresh(60)
    rows = clean + [(100, long, "en"), (101, near, "en"), (102, long, None), (200, f"{fresh(30)} {passage} {fresh(30)}", "en"), (201, f"{fresh(30)} {passage} {fresh(30)}", "en"), (300, None, "en"), (301, "123 456", "en"), (302, "", None)]
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
        path = str(tmp_path / f"stage{len(seen)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r for r in docs.collect()})
    whole = {i for i, _, _ in rows} - {300, 301, 302}
    assert set(seen[0]) == whole and seen[0][102]["lang"] == "en"
    assert set(seen[1]) == whole - {102}
    assert set(seen[2]) == whole - {102, 101}
    assert set(seen[3]) == set(seen[2]) and passage in seen[3][200]["text"] and passage not in seen[3][201]["text"]
    assert all(seen[3][k]["text"] == t for k, t, _ in clean)
    assert set(seen[4]) == set(seen[3])
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in result.collect()} == set(seen[4])
