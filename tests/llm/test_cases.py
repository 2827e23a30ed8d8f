"""Ties, repeated rows, long texts and odd numbers; and parts that SQL can't express against plain versions."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import by_id, distance, frame, words

from tabulon.llm import embedding_dedup, exact_dedup, jaccard_join, language_id, line_dedup, packing, queries, sentencepieces, toxicity
from tabulon.llm import textblocks as tb

# --- 1


def greedy_phrases(sample, text):
    """How many longest matches with sample, one after the other, make up text; a phrase ends before what doesn't fit."""
    count, now = 1, []
    for c in text:
        longer = [*now, c]
        if any(sample[k : k + len(longer)] == longer for k in range(len(sample))):
            now = longer
        else:
            count += 1
            now = [c] if c in sample else []
    return count


def test_language_is_that_of_the_fewest_normalised_phrases(spark):
    rng = random.Random(1)
    make = lambda stems, n: " ".join("".join(rng.choice(stems) for _ in range(2)) for _ in range(n))
    stems = {"aa": ["ba", "na", "lo", "mi"], "bb": ["ba", "nu", "lo", "ke"], "cc": ["zu", "na", "ro", "mi"]}
    samples = {k: make(v, n) for (k, v), n in zip(stems.items(), (300, 40, 120), strict=True)}
    texts = [make(v, 6) for v in stems.values() for _ in range(12)] + ["ba", "x", "lo ro"]
    got = language_id.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples).collect()
    parser = language_id.CrossParser(samples)
    plain = {k: parser.classes(s).tolist() for k, s in samples.items()}
    for r in got:
        codes = parser.classes(texts[r["doc_id"]]).tolist()
        found = {k: greedy_phrases(s, codes) * math.log2(len(s)) for k, s in plain.items()}
        best, second = sorted(found.values())[:2]
        assert r["lang_pred"] == min(found, key=lambda k: (found[k], k))
        assert r["score"] == pytest.approx(1 - best / max(second, 1)) and r["phrase_rate"] == pytest.approx(greedy_phrases(plain[r["lang_pred"]], codes) / len(codes))


def test_equal_languages_tie_by_name(spark):
    rows = spark.createDataFrame([(1, "abc abc"), (1, "abc abc"), (2, "qqq")], "doc_id long, text string")
    got = language_id.language_id(rows, {"zz": "abc def abc", "mm": "abc def abc"}).collect()
    assert [r["lang_pred"] for r in got] == ["mm"] * 3 and [r["score"] for r in got] == [0.0] * 3


# --- 2, 4


def test_repeated_rows_are_packed_each(spark):
    docs = frame(spark, [(7, "one two three"), (7, "one two three"), (8, "four")])
    path = queries.tokenizer_file("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, size=64).collect()
    assert collections.Counter(p["doc_id"] for p in pieces) == {7: 2, 8: 1}
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == 3


def test_repeated_rows_are_encoded_each(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    got = sentencepieces.encode(frame(spark, [(1, "same text"), (1, "same text"), (None, "no id")]), path).collect()
    assert sorted(((r["doc_id"] or 0), tuple(r["ids"])) for r in got)[1] == sorted(((r["doc_id"] or 0), tuple(r["ids"])) for r in got)[2] and len(got) == 3


# --- 3


def test_texts_of_rows_without_ids(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(None, "alone"), (None, "alone"), (4, "x"), (None, "x")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"] or 0, r["kept"]) for r in got) == [(0, 0, 0, False), (0, 0, 0, False), (0, 4, 1, False), (4, 4, 1, True)]


# --- 5


def test_long_and_repeated_lines(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000)).strip()
    changed = long[:40_000] + "Z" + long[40_001:]
    gone = long[:100] + long[101:]
    docs = frame(spark, [(5, long), (6, changed), (7, gone), (8, long[:-300]), (9, f"{long}\n{long}"), (5, long)])
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(docs).collect()}
    assert {k: r["rep_doc_id"] for k, r in got.items()} == {(5, 0): 5, (6, 0): 5, (7, 0): 5, (8, 0): 8, (9, 0): 5, (9, 1): 5}
    assert got[5, 0]["copies"] == 4 and got[5, 0]["kept"] and not got[9, 1]["kept"]
    # rows of one line that is the first are kept alike
    assert line_dedup.line_classes(docs).where("doc_id = 5 and kept").count() == 2


def test_marks_never_rule_out_a_line_within_one_edit(spark):
    rng = random.Random(4)
    lines = []
    for k in range(300):
        a = "".join(rng.choice("abé ñ") for _ in range(rng.randrange(16, 60)))
        b, at = list(a), rng.randrange(len(a))
        b[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
        lines += [(2 * k, a), (2 * k + 1, "".join(b))]
    df = spark.createDataFrame(lines, "id long, line string").withColumn("n", F.length("line"))
    index = line_dedup.entries(df, 1, True).select("key", F.col("id").alias("a"), F.col("mark").alias("ma"))
    probe = line_dedup.entries(df, 1, False).select("key", F.col("id").alias("b"), F.col("mark").alias("mb"))
    found = {frozenset((r["a"], r["b"])) for r in index.join(probe, "key").where(line_dedup.fits("ma", "mb", 1)).where("a <> b").collect()}
    text = dict(lines)
    assert all(frozenset((2 * k, 2 * k + 1)) in found for k in range(300) if distance(text[2 * k], text[2 * k + 1]) <= 1)


# --- 8


def plain_words(text):
    """(word without marks at its ends, word without disguise) of each word, as lower-case bytes."""
    core = re.compile(rb"[A-Za-z0-9@$\x80-\xff]")
    out = []
    for raw in re.findall(rb"[^\x20\x09-\x0d]+", text.encode()):
        places = [m.start() for m in core.finditer(raw)]
        if places:
            word = raw[places[0] : places[-1] + 1]
            bare = bytes(toxicity._PLAIN[b] for b in word)
            letters = [(i, b) for i, b in enumerate(bare) if 97 <= b <= 122 or b >= 128]
            out.append((word, bytes(b for i, b in letters if not (i and bare[i - 1] == b and b < 128))))
    return out


def hash_of(raw):
    body = np.frombuffer(raw, np.uint8)
    return tb.span_hashes(body, np.array([0]), np.array([len(body)]))[0]


def test_features_against_a_plain_version():
    rng = random.Random(5)
    pool = ["you", "IDIOT", "id1ot", "sc-um", "scuuum", "hello", "World", "42", "!!", "wow!?", "(mOrOn)", "your", "été", "a$$", "tree"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(60)] + ["", "?!", "you " * 400]
    lower = lambda w: w.lower()
    lexicon = {b"idiot": 3.0, b"scum": 2.0, b"moron": 2.6}
    made = sorted((hash_of(w), s) for w, s in lexicon.items())
    whole = (np.array([h for h, _ in made]), np.array([s for _, s in made]))
    none = (np.empty(0, np.uint64), np.empty(0))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offsets, [whole, whole, none, none], toxicity.pronoun_hashes())
    for t, row in zip(texts, got, strict=True):
        found = plain_words(t)
        n = max(1, len(found))
        one = [lexicon.get(lower(w), 0) for w, _ in found]
        two = [lexicon.get(b, 0) for _, b in found]
        strong = [k for k in range(len(found)) if max(one[k], two[k]) > 2.5]
        says = [k for k, (w, _) in enumerate(found) if lower(w).decode("utf-8", "replace") in toxicity.SECOND_PERSON]
        near = [k for k in strong if any(abs(k - j) <= toxicity.NEAR for j in says)]
        letters = sum(b < 128 and chr(b).isalpha() or b >= 128 for b in t.encode())
        only = lambda w: [b for b in w if chr(b).isalpha() and b < 128 or b >= 128]
        upper = sum(len(only(w)) >= 2 and all(65 <= b <= 90 for b in only(w)) for w, _ in found)
        hidden = sum(0 < len(only(w)) < len(w) for w, _ in found)
        want = [math.log1p(len(found))]
        for hits in (one, two):
            want += [sum(hits) / n, max(hits, default=0), math.log1p(sum(h > 2.5 for h in hits))]
        want += [0.0] * 6 + [len(near) / n, len(near) / max(1, len(strong)), sum(65 <= b <= 90 for b in t.encode()) / max(1, letters), upper / n]
        size = max(1, len(t.encode()))
        want += [t.count("!") / size, t.count("?") / size]
        assert np.allclose(row[: len(want)], want), t
        assert row[-1] == pytest.approx(hidden / n)


def test_trees_against_a_plain_version():
    """The first split of the first tree is the best of all, and raw() walks the trees as they were grown."""
    rng = np.random.default_rng(6)
    x = np.round(rng.random((300, 3)), 2)
    y = (x[:, 1] > 0.6).astype(float)
    model = toxicity.BoostedTrees(trees=5, depth=2).fit(x, y)
    column, cut, _ = model.nodes[0]
    p = y.mean()

    def gain(k, c):
        left = x[:, k] < c
        side = lambda rows: (y[rows] - p).sum() ** 2 / (rows.sum() * p * (1 - p) + 1)
        return side(left) + side(~left)

    best = max(gain(k, c) for k in range(3) for c in model.cuts[k])
    assert gain(column[0], model.cuts[column[0]][cut[0]]) == pytest.approx(best)
    raw = np.full(len(x), model.base)
    for column, cut, value in model.nodes:
        for i, row in enumerate(x):
            at = 0
            while at < len(cut):
                at = 2 * at + 1 + int((model.cuts[column[at]] <= row[column[at]]).sum() > cut[at])
            raw[i] += value[at - len(cut)]
    assert np.allclose(model.raw(x), raw)


def test_isotonic_is_the_nearest_rising_step():
    rng = np.random.default_rng(7)
    raw, y = rng.random(12), rng.integers(0, 2, 12).astype(float)
    x, steps = toxicity.isotonic(raw, y)
    fitted = np.interp(np.sort(raw), x, steps)
    values = y[np.argsort(raw)]
    # min-max formula of isotonic regression
    want = [max(min(values[a : b + 1].mean() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
    assert np.allclose(fitted, want)


def test_repeated_and_tied_texts_score_alike(spark):
    rng = random.Random(8)
    rows = [(k, words(rng, 20) + (" scum" if k % 2 else "")) for k in range(400)]
    docs = frame(spark, [*rows, (1, rows[1][1]), (900, rows[1][1]), (None, rows[1][1])])
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels, F.lit(False))).collect()
    assert len(got) == 403 and len({r["score"] for r in got if r["doc_id"] in (1, 900, None)}) == 1


# --- 9


def test_doubles_keep_their_precision(spark):
    tiny, huge = [1e-300, 2e-300, -1e-300], [1e300, 2e300, -1e300]
    near, far = [1.0, 0.0, 0.0], [0.95 + 1e-9, math.sqrt(1 - (0.95 + 1e-9) ** 2), 0.0]
    off = [0.95 - 1e-9, -math.sqrt(1 - (0.95 - 1e-9) ** 2), 0.0]
    rows = [(1, tiny), (2, huge), (3, near), (4, far), (5, off), (6, [5e-324, 0.0, 0.0])]
    got = by_id(embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumnRenamed("vec_id", "doc_id").collect(), "n_links", "component_id")
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (2, 3)}


# --- 10


def test_sets_of_one_and_two(spark):
    texts = ["a", "a b", "b", "b c", "c d", "d e f", "A", "a  b"]
    rows = list(enumerate(texts))
    sets = [frozenset(t.lower().split()) for t in texts]
    up = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j]):
                up[i] = up[j] = min(up[i], up[j])
    for limit in (1, 2, 5):
        got = by_id(jaccard_join.jaccard_groups(frame(spark, rows), k=1, percent=50, limit=limit).collect(), "component_id")
        assert [got[k][0] for k in range(len(texts))] == up
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_groups(frame(spark, rows), percent=40)
