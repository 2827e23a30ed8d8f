"""Operators on tables where one topic or one text is shared by a large part of the rows."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import embedding_dedup, line_dedup, suffix_dedup
from tabulon.llm.common import stored


def test_embedding_recall_in_a_hot_cluster(spark):
    rng = np.random.default_rng(3)
    n, hot, pairs, cosine = 12_000, 4_000, 600, 0.951
    x = embedding_dedup.unit(rng.standard_normal((n, 64)))
    centre = embedding_dedup.unit(rng.standard_normal((1, 64)))
    aside = lambda y: embedding_dedup.unit((r := rng.standard_normal(y.shape)) - (r * y).sum(1, keepdims=True) * y)
    x[:hot] = np.sqrt(0.88) * centre + np.sqrt(0.12) * aside(np.repeat(centre, hot, 0))
    a, b = rng.permutation(hot)[: 2 * pairs].reshape(2, -1)
    x[b] = cosine * x[a] + np.sqrt(1 - cosine**2) * aside(x[a])
    x = x.astype(np.float32).astype(float)
    y = embedding_dedup.unit(x)
    links = [(i + low, j) for low in range(0, n, 2000) for i, j in zip(*np.nonzero(y[low : low + 2000] @ y.T >= 0.95), strict=True) if i + low < j]
    assert len(links) >= pairs
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.embedding_groups(vectors.repartition(4, F.col("vec_id"))).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.995 * len(links)


def test_passages_that_end_in_a_hot_text(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    hot = fresh(30)
    heads = [fresh(20) for _ in range(250)]
    rows = [(k, f"{fresh(10)} {heads[k % 250]} {hot} {fresh(30)}") for k in range(750)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, F.col("doc_id"))
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(docs).collect() if not r["kept"]}
    assert set(got) == set(range(250, 750))
    assert all((r["start_word"], r["n_words"], r["first_doc_id"]) == (10, 50, k % 250) for k, r in got.items())


def test_passages_with_a_hot_text_inside_partitions(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for _ in range(8):
        hot, heads = fresh(30), [fresh(20) for _ in range(60)]
        rows += [f"{fresh(10)} {heads[k % 60]} {hot} {fresh(30)}" for k in range(180)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(docs).collect() if not r["kept"]}
    assert set(got) == {k for k in range(len(rows)) if k % 180 >= 60}
    assert all((r["start_word"], r["n_words"], r["first_doc_id"]) == (10, 50, k - k % 180 + k % 60) for k, r in got.items())


def test_paragraphs_in_a_row(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{fresh(20)} " + " ".join([fresh(55)] * times) + f" {fresh(20)}") for k, times in enumerate([3, 4, 6] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in suffix_dedup.without_passages(docs, suffix_dedup.repeated_passages(docs)).collect()}
    for k, text in rows:
        words = text.split()
        assert left[k] == [*words[:75], *words[-20:]]


@pytest.mark.parametrize(("least", "parts"), [(50, 7), (12, 3), (12, 16)])
def test_passages_against_all_windows(spark, least, parts):
    """Words are cut if, and only if, they lie in a window of least words that stands at an earlier place as well."""
    rng = random.Random(least + parts)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hot, cores = fresh(least * 4 // 5), [fresh(least) for _ in range(6)]
    rows = []
    for k in range(12):  # pairs that share a whole passage, most of which stands in many other documents
        head = fresh(least - len(hot))
        rows += [(3 * k + j, [*fresh(5 + k), *head, *hot, *fresh(9)]) for j in range(2)]
    rows += [(100 + k, [*fresh(k % 7), *hot, *fresh(12)]) for k in range(60)]
    for k in range(60):
        parts_of = [rng.choice([fresh(rng.randrange(20)), rng.choice(cores), rng.choice(cores)[: least - 2], hot]) for _ in range(rng.randrange(6))]
        rows.append((200 + k, [w for p in parts_of for w in p]))
    rows += [(300 + k, ["again"] * (least * (k + 1) + 3)) for k in range(3)] + [(310, fresh(least // 2 + 3) * 5), (311, []), (312, cores[0]), (312, cores[0])]
    rows += [(320 + k, [*cores[1], *cores[1], *fresh(k)]) for k in range(4)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in [*rows, (None, hot * 2)]], "doc_id long, text string").repartition(parts)
    text = dict(rows)
    places = collections.defaultdict(list)
    for i in sorted(text):
        for at in range(len(text[i]) - least + 1):
            places[tuple(text[i][at : at + least])].append((i, at))
    again = {(i, at + k) for found in places.values() for i, at in found if any((j, b) < (i, at) and (j != i or at - b >= least) for j, b in found) for k in range(least)}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        spans = suffix_dedup.repeated_passages(docs, least=least).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r["doc_id"], r["start_word"] + k) for r in spans if not r["kept"] for k in range(r["n_words"])}
    assert got == again
    kept = {(r["doc_id"], r["start_word"] + k) for r in spans if r["kept"] for k in range(r["n_words"])}
    assert not kept & again
    often = {(i, at + k) for found in places.values() if len(found) > 1 for i, at in found for k in range(least)}
    assert kept <= often - again


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_are_verified_between_common_ends(spark, edits):
    rng = random.Random(7)
    rows = []
    for k in range(160):
        one = "".join(rng.choice("abé ") for _ in range(rng.choice([16, 40, 700, 5000])))
        two = list(one)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(two))
            two[at : at + 1] = rng.choice([[], ["z"], [two[at], "z"], [two[at], two[at]]])
        rows.append((k, k, one, "".join(two)))
    pairs = spark.createDataFrame(rows, "a long, b long, one string, two string")
    cut = stored(line_dedup.middles(pairs, edits), "middles")
    found = {r["a"] for r in cut.where("one is not null").where(line_dedup.within("one", "two", edits)).collect()}
    near = {r["a"] for r in pairs.where(F.levenshtein("one", "two") <= edits).collect()}
    assert found == near and 0 < len(near) < 160
    if edits == 1:
        # what lies between two edits that are far apart isn't gone through
        assert cut.agg(F.max(F.length("one"))).first()[0] <= 6
