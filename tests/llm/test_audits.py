"""Filter audit, best-fit packing and Merkle manifest against SQL and plain versions, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bestfit, filter_audit, manifest, queries

#: Some of the columns have names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, mask string, key string, h int, class string, kids string, tree long"


def frame(spark, rows):
    """rows: doc_id, text, source."""
    return spark.createDataFrame([(i, t, None if i and i % 7 == 0 else "en", s, None if t is None else len(t), 1, "m", "k", 2, "c", "x", 9) for i, t, s in rows], DOCS)


def sample():
    rng = random.Random(11)
    text = lambda n, size: " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    rows = [(k, text(rng.choice([5, 150, 250, 400]), rng.choice([20, 5000])) + rng.choice(["", "", "\n\n ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " #1", "\x0b$ \r\n|"]), rng.choice(["a", "b", "B", "ü"])) for k in range(60)]
    hot = text(300, 5000)
    rows += [(100 + k, hot, "hot") for k in range(40)]
    rows += [(200, None, None), (201, "", "a"), (202, " \n ", ""), (203, "é" * 300 + "X", "a"), (204, text(30_000, 10**6), "b"), (205, text(30_000, 10**6), "lone")]
    return rows + [(300 - k, rows[k][1], "a") for k in range(5)]


def duck(con, spark, name, df):
    con.register(f"{name}_", df.toPandas())
    shown = ", ".join(f"{c}::{'bigint' if t == 'bigint' else 'int' if t == 'int' else 'varchar'} as {c}" for c, t in df.dtypes)
    con.execute(f"create table {name} as select {shown} from {name}_")


def same(df, con, sql):
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: sorted((tuple(None if v is None or v != v else v for v in r) for r in x[list(got.columns)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert plain(got) == plain(want)
    return got


# --- 11 filter audit


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        parts[s or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for step, x in enumerate(order):
                here = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                lost = [labels.get(i, (0, 0)) for i, _ in here]
                out[part, order, step + 1] = [len(left), len(here), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in docs), sum(q == 1 for q, _ in lost), sum(t == 1 for _, t in lost)]
                gone += here
                shapley[x] += len(here)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order):
                out[part, order, step + 1].append(shapley[x])
    return out


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 2], ids=["hashes", "hashes that meet"])
def test_filter_audit(spark, hashed):
    rows = [*sample(), (None, "alone", "a"), (None, sample()[0][1], "a"), (3, sample()[3][1], "a")]
    labels = {i: (i % 2, int(i % 5 == 0)) for i, _, _ in rows if i is not None and i % 3}
    told = spark.createDataFrame([(i, *x, "x") for i, x in labels.items()] + [(None, 1, 1, "x"), (1, None, None, "x")], "doc_id long, quality int, toxic int, n string")
    got = filter_audit.filter_audit(frame(spark, rows), told, hashed=hashed).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_filter_audit_equals_sql(spark):
    con, docs = duckdb.connect(), frame(spark, sample())
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    duck(con, spark, "documents", docs)
    duck(con, spark, "labels", labels)
    same(filter_audit.filter_audit(docs, labels), con, filter_audit.SQL)
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    none = filter_audit.filter_audit(docs, labels.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_classes_are_refined_block_by_block(spark):
    """Texts that differ only in their first, second or last block, and copies of each."""
    base = "".join(chr(97 + k * k % 26) for k in range(30_000))
    texts = [base, "A" + base[1:], base[:300] + "A" + base[301:], base[:-1] + "A", base[:-1], "short", "shorT", ""]
    rows = [(10 * k + j, t, "s") for k, t in enumerate(texts) for j in range(3 if k != 4 else 1)]
    marked = filter_audit.marks(frame(spark, rows).select("doc_id", "text", F.lit("s").alias("part")))
    assert sorted(r["n"] for r in filter_audit.duplicate_classes(marked).collect()) == [3] * 7
    fails = {r["doc_id"]: r["mask"] >> 4 for r in filter_audit.failures(frame(spark, rows).select("doc_id", "text", F.lit("s").alias("part"))).collect()}
    assert fails == {i: int(i % 10 > 0) for i, _, _ in rows}


# --- 12 best-fit packing


def exact_bins(lengths, size):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold():
    rng = random.Random(2)
    met = 0
    for _ in range(150):
        size = rng.choice([7, 12, 20, 31])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=size + 1)
        bound, least = bestfit.lower_bound(counts), exact_bins(lengths, size)
        bins, offsets, n = bestfit.best_fit_decreasing(np.array(lengths), size)
        assert -(-sum(lengths) // size) <= bound <= least <= n == len(set(bins.tolist()))
        met += bound == least
        for b in set(bins.tolist()):
            inside = sorted((o, x) for o, x, c in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if c == b)
            assert [o for o, _ in inside] == [0, *np.cumsum([x for _, x in inside])[:-1]] and sum(x for _, x in inside) <= size
    assert met > 140


def test_dual_feasible_functions():
    """No lengths that fit together have values above a full sequence's."""
    size = 12
    values, full = bestfit._families(size)
    sets = [c for n in range(1, 7) for c in itertools.combinations_with_replacement(range(1, size + 1), n) if sum(c) <= size]
    for c in sets:
        assert (values[:, list(c)].sum(1) <= full).all(), c


def test_groups_exchange_pieces(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 99), rng.randint(30, 70), 100]) for _ in range(4000)]
    got = bestfit.pack_pieces(spark.createDataFrame(list(enumerate(lengths)), "key long, length long"), 100, 300).collect()
    assert sorted((r["key"], r["length"]) for r in got) == list(enumerate(lengths))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1]] and sum(n for _, n in x) <= 100
    bound = bestfit.lower_bound(np.bincount(lengths, minlength=101))
    alone = sum(bestfit.best_fit_decreasing(np.array(lengths[k::14]), 100)[2] for k in range(14))
    assert bound <= len(sequences) <= bound + 4 < alone + 4


def test_bestfit_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    rows = [*sample(), (None, "no id", "a"), (7, "again", "a"), (7, "again", "a")]
    docs = frame(spark, rows)
    got = bestfit.pack_best_fit(docs, queries.tokenizer_file("byte_bpe_50k.json"), payload="crc32", group=50).collect()
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(itertools.pairwise(edges))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1]] and sum(n for _, n in x) <= 2048
    lengths = np.array([w[3] for w in want])
    assert bestfit.lower_bound(np.bincount(lengths, minlength=2049)) <= len(sequences) <= bestfit.best_fit_decreasing(lengths, 2048)[2] + 2
    shown = bestfit.pack_best_fit(docs, queries.tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in shown), key=key) == sorted(want, key=key)
    assert bestfit.pack_best_fit(docs.limit(0), queries.tokenizer_file("byte_bpe_50k.json"), payload="crc32").count() == 0


# --- 13 Merkle manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of each row."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(shown, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))

    def climb(nodes, paths):
        """nodes: digests with the rows below each; paths grow by (left, right)."""
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), 3):
                run = nodes[k : k + 3]
                for j, (_, below) in enumerate(run):
                    for b in below:
                        paths[b].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
                up.append((H(*(h for h, _ in run)), [b for _, below in run for b in below]))
            nodes = up
        return nodes[0]

    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), k))
    paths, tops = collections.defaultdict(list), []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        tops.append(climb([(x[2], [x[3]]) for x in sorted(groups[s])], paths))
    root = climb([(h, below) for h, below in tops], paths)[0]
    subroot = {b: h for h, below in tops for b in below}
    out = []
    for k, r in enumerate(rows):
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        now = leaf(r, r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"])
        for left, right in paths[k]:
            now = H(left, now, right)
        out.append((r["doc_id"], leaf(r, r["text"]), subroot[k], root, H(*(x + y for x, y in paths[k])), now, now == root))
    return out


@pytest.mark.parametrize("case", ["many", "one group", "one row", "lone groups"])
def test_manifest(spark, case):
    rows = [*sample(), (None, "no\nid", "a"), (None, "no id", None), (7, "again\n", "a"), (7, "again\n", "a"), (7, "other", "a"), (7, "again\n", "a")]
    rows = {"many": rows, "one group": [(i, t, "x") for i, t, _ in rows[:28]], "one row": rows[:1], "lone groups": [(k, f"{k}\n", f"s{k}") for k in range(10)]}[case]
    docs = frame(spark, rows).repartition(3)
    got = [tuple(r) for r in manifest.verified_rows(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest([r.asDict() for r in docs.collect()]), key=repr)
    assert case == "one row" or len({r[-1] for r in got}) == 2
    assert len(got) == len(rows)


def test_manifest_equals_sql(spark):
    con, docs = duckdb.connect(), frame(spark, sample())
    duck(con, spark, "documents", docs)
    same(manifest.verified_rows(docs), con, manifest.SQL)
    assert manifest.verified_rows(docs.limit(0)).count() == 0
