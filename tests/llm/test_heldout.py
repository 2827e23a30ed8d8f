"""Held-out quality on the correctness tables, where few rows are labelled."""

from __future__ import annotations

from tabulon.llm import queries


def test_toxicity_with_few_labels(spark):
    """286 labelled rows to learn from, 33 of them toxic."""
    told = queries.table(spark, "/root/testdata/sf0.01", "labels").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(told, "doc_id").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert len(bad) == 18 and auc >= 0.95
    hit = [r["toxic"] for r in rows if r["predicted"]]
    assert sum(hit) >= 12 and sum(hit) >= 0.9 * len(hit)
