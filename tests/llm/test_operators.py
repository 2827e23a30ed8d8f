"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import common, embedding_dedup, exact_dedup, jaccard_join, language_id, line_dedup, packing, pretokens, queries, sentencepieces, suffix_dedup, toxicity, url_filters
from tabulon.llm import textblocks as tb
from tabulon.llm.common import components

#: Documents have these columns besides; some clash with names that operators use.
DOCS = "doc_id long, text string, key string, component string, n long, rep string, h1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "c", 7, "r", 1) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def by_id(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)] + [(900, 900)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language ID


def test_workers_get_small_batches_and_give_memory_back(spark):
    common.prepare(spark)
    sizes = spark.range(0, 9000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 9000 and max(r["n"] for r in sizes) <= common.BATCH
    mb = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    kept = []

    def run(batches):
        for n in batches:
            x = [bytearray(20_000) for _ in range(n)]
            kept.append(x[-1])
            yield mb()

    before = mb()
    (most,) = common.lean(run)(iter([10_000]))
    assert most - before > 150 and mb() - before < 60


def test_a_worker_holds_one_model():
    made = []
    ask = lambda *key: common.held(key, lambda: made.append(weakref.ref(x := set(key))) or x)
    assert ask("a", 1) is ask("a", 1) and len(made) == 1
    assert ask("b", 1) == {"b", 1} and made[0]() is None and made[1]() is not None


def test_cross_parsing_counts_greedy_phrases():
    sample = "the cat sat on the mat and the dog"
    parser = language_id.CrossParser({"x": sample})
    for text in ("the cat and the dog", "matsat", "ththththe", "zzz", "a"):
        codes = parser.classes(text)
        known = parser.classes(sample).tolist()
        count, now = 1, []
        for c in codes.tolist():
            longer = [*now, c]
            if any(known[k : k + len(longer)] == longer for k in range(len(known))):
                now = longer
            else:
                count += 1
                now = [c] if c in known else []
        assert parser.phrases(codes, np.array([0, len(codes)]))[0, 0] == count, text


def test_language_id(spark):
    rng = random.Random(5)
    stems = {"xx": ["abra", "cada", "bra", "kan"], "yy": ["tolo", "mimi", "pupo", "re"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, text("xx" if k % 2 else "yy", 30), "xx" if k % 2 else "yy") for k in range(60)]
    rows += [(100, None, "xx"), (101, "", None), (102, "12 !?", "yy"), (103, text("xx", 5000), None), (0, text("yy", 30), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    samples = language_id.training_sample(docs, 8, 2000, F.col("doc_id") % 5 == 0)
    assert set(samples) == {"xx", "yy"}
    got = language_id.language_id(docs, samples).collect()
    assert len(got) == len(rows)
    found = by_id(got, "lang_pred", "score")
    assert all(found[k][0] == ("xx" if k % 2 else "yy") for k in range(60)) and found[103][0] == "xx"
    assert [found[k] for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.language_id(docs.limit(0), samples).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs, {}).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).where("held_out")
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "lang")
    good = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert good > 0.9


# --- 2 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


def odd_texts(n, rng):
    parts = ["a", "'s", "'", "'re", " ", "  ", "\n", "\t", "1", "é", "!", "日本", "x", "<|endoftext|>", "\u00a0", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_pretokens_equal_the_library(tokenizer):
    texts = [*odd_texts(400, random.Random(1)), "", "<|endoftext", "we'll they're '' 'tis"]
    raw = [t.encode() for t in texts]
    encoder = pretokens.Encoder(queries.tokenizer_file("byte_bpe_50k.json"))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = []
    for low, high in tb.blocks(offsets, 200):
        ids, at = encoder.block(np.frombuffer(b"".join(raw[low:high]), np.uint8), offsets[low : high + 1] - offsets[low])
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, words(rng, rng.choice([0, 3, 40, 400, 3000]))) for k in range(80)] + [(100, None), (101, ""), (None, "no id")]
    docs = frame(spark, rows).repartition(40)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    path = queries.tokenizer_file("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, size=256, open_windows=4).collect()
    whole = collections.defaultdict(dict)
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == p["length"] and p["doc_tokens"] == len(want[p["doc_id"]])
        whole[p["doc_id"]][p["start"]] = p["ids"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {i: [x for s in sorted(parts) for x in parts[s]] for i, parts in whole.items()} == want
    for parts in sequences.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert sum(sum(n for _, n in s) < 256 for s in sequences.values()) <= 1
    digests = {(p["doc_id"], p["start"]): p["ids_crc32"] for p in packing.pack(docs, path, size=256, open_windows=4, payload="crc32").collect()}
    for (i, start), crc in digests.items():
        n = min(s for s in [*(s for d, s in digests if d == i and s > start), len(want[i])])
        assert crc == zlib.crc32(np.array(want[i][start:n], "<u4").tobytes())
    assert packing.pack(docs.limit(0), path).count() == 0


# --- 3 exact dedup


def test_cuckoo_index():
    rng = random.Random(4)
    index, live = exact_dedup.CuckooIndex(8), {}
    for k in range(5000):
        key = hashlib.sha256(str(rng.randrange(2500)).encode()).digest()
        if key in live and rng.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            index.insert(key, [k])
            live[key] = [k]
        assert index.get(key) == live.get(key)
    assert dict(index.items()) == live and not index.delete(b"0" * 32)


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\n b"), (9, "a b "), (4, None), (2, ""), (7, "\u00a0"), (3, "a b"), (8, "x " * 100_000), (None, "a b")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if i is not None and re.sub(r"[\x20\x09-\x0D]+", " ", t or "") == norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["doc_id"] == min(same))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    seen = exact_dedup.digests(frame(spark, rows)).where("doc_id is not null")
    out = spark.createDataFrame([(hashlib.sha256(b"a b").hexdigest(), 3), (hashlib.sha256(b"").hexdigest(), 1)], "text_sha256 string, n long")
    left = {bytes(r["digest"]).hex(): r["group_size"] for r in exact_dedup.build_index(seen, out).collect()}
    assert hashlib.sha256(b"a b").hexdigest() not in left and left[hashlib.sha256(b"").hexdigest()] == 1
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# --- 4 SentencePiece


def test_sentencepieces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(6)
    texts = [*odd_texts(200, rng), None, "", " ", "  two", "ab " * 9, "a" * 3000, "The quick brown fox. " * 5, "\u2581x\u2581", "\U0001f600 ok"]
    got = {r["doc_id"]: r for r in sentencepieces.decode(sentencepieces.encode(frame(spark, list(enumerate(texts))), path), path).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for k, text in enumerate(texts):
        assert got[k]["ids"] == model.encode(text or ""), text
        assert got[k]["decoded"] == got[k]["normalised"] == (text or "").replace("\u2581", " ")
    digests = sentencepieces.encode(frame(spark, list(enumerate(texts))), path, digest=True).collect()
    assert all(r["round_trip"] and r["n_ids"] == len(got[r["doc_id"]]["ids"]) and r["ids_crc32"] == got[r["doc_id"]]["ids_crc32"] for r in digests)
    assert sentencepieces.encode(frame(spark, []), path).count() == 0


def test_pieces_are_searched_for_once_in_many_texts(spark, monkeypatch):
    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([words(rng, 9000) for _ in range(20)])], names=["doc_id", "text"])
    searches = []
    monkeypatch.setattr(sentencepieces.Pieces, "encode_units", lambda self, units, f=sentencepieces.Pieces.encode_units: searches.append(len(units)) or f(self, units))
    path = queries.tokenizer_file("piece_bpe_32k.model")
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, kind: list(run(iter([batch]))))
    got = sentencepieces.encode(frame(spark, []), path, digest=True)
    assert batch.column(1).nbytes > 3 * tb.BLOCK and len(searches) == 1 and all(r for part in got for r in part.column("round_trip").to_pylist())


def test_pieces_stand_side_by_side():
    model = sentencepieces.Pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(13)
    names = [n for n, _ in model.known if set(n) <= set("abenrst▁")]
    for _ in range(20_000):
        a, b = rng.choice(names), rng.choice(names)
        assert model.stand(a, b) == (model.merged(a + b) == [a, b]), (a, b)


# --- 5 line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b"])
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within("a", "b", edits).alias("ok")).collect()
    assert all(r["ok"] == (distance(r["a"], r["b"]) <= edits) for r in got)


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    rng = random.Random(8)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(10, 40))).strip() or "x" for _ in range(12)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(5)):
            b = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choice(["", "e", "z"])
            lines.append(rng.choice(["", " "]) + "".join(b) + rng.choice(["", "\r", " "]))
        rows.append((k, "\n".join([*lines, ""])))
    rows += [(50, None), (51, ""), (52, "\n \n"), (0, rows[0][1]), (None, base[0])]
    flat = [(i, n, line.strip(" \t\x0b\x0c\r")) for i, t in rows for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\x0b\x0c\r")]
    texts = sorted({x for _, _, x in flat})
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if min(len(a), len(b)) >= 16 and distance(a, b) <= edits]
    group = closure(texts, links)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    head = {g: min(((i, n) for i, n, x in flat if group[x] == g), key=order) for g in set(group.values())}
    got = line_dedup.line_classes(frame(spark, rows), edits=edits).collect()
    key = lambda x: (*order(x), *map(str, x))
    assert sorted(((r["doc_id"], r["line_no"], r["rep_doc_id"], r["rep_line_no"]) for r in got), key=key) == sorted(((i, n, *head[group[x]]) for i, n, x in flat), key=key)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["rep_doc_id"], r["rep_line_no"])) for r in got)
    docs = frame(spark, rows)
    cut = line_dedup.without_repeated_lines(docs, line_dedup.line_classes(docs, edits=edits))
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = [x for r in cut.collect() for x in (r["text"] or "").split("\n") if x.strip() and r["doc_id"] is not None]
    heads = {head[g] for g in head if head[g][0] is not None}
    assert sum(1 for i, n, _ in flat if (i, n) in heads) == len(left)
    assert line_dedup.line_classes(frame(spark, [])).count() == 0


# --- 6 URL filters


def plain_verdict(url, sites, blocked):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for r, v in sites if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    word = any(w in re.split("[^0-9a-z]+", f"{host} {path}".lower()) for w in blocked)
    _, rule, verdict = max(fits) if fits else (0, None, "block" if word else "allow")
    return host, path, rule, verdict


URLS = ["http://a.example.com/en/x", "https://www.example.com/en/", "http://EXAMPLE.com/en/1?x", "http://x.net/es/", "http://x.net/fr", "http://x.net/de/casino", "http://x.org", "http://x.com", "no url", None, "", "http://", "http://casino.com/", "http://notexample.com/en/", "http://x.net/es/?a://b", "ftp://User@X.COM:80/", "http://com/", "http://x.org/Warez?casino"]
URLS += ["http://my site.com/", "https://foo bar.example.com/en/1", "http://a b.net/es/x", "http://a\tb.net/fr/", "http://a\nb.example.com/en/", "http://x.com\n/", "http://é.net/es/", "http://x.net/es/" + "a/" * 50_000, "http://" + "a." * 20_000 + "net/fr/", "http://x.net/es/", "http://x.net/ES/"]


def test_url_filters(spark):
    rows = [(k, u, 1) for k, u in enumerate(URLS)]
    got = url_filters.url_filter(spark.createDataFrame([*rows, rows[3]], "page_id long, url string, host int")).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = plain_verdict(URLS[r["page_id"]], url_filters.SITE_RULES, url_filters.BLOCKED_WORDS)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want, URLS[r["page_id"]][:99]
    assert url_filters.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_filters_with_many_rules(spark):
    rng = random.Random(14)
    sites = [(f"s{k}-x.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'a/', 'a/b/', 'pre'])}", rng.choice(["allow", "block"])) for k in range(100_000)]
    sites += [(f"sub.{r}", "allow" if v == "block" else "block") for r, v in sites[:500]]
    rules = [*(url_filters.site_rule(*x) for x in sites), url_filters.word_rule("casino")]
    urls = URLS + [f"http://{rng.choice(['', 'sub.', 'no'])}{rng.choice(sites)[0].partition('/')[0]}/{rng.choice(['', 'a/', 'a/b/c', 'prefix', 'casino'])}" for _ in range(600)]
    urls += [f"http://sub.{r}" for r, _ in sites[:100]]
    got = url_filters.url_filter(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), rules).collect()
    assert len(got) == len(urls)
    by_host = collections.defaultdict(list)
    for r, v in sites:
        by_host[r.partition("/")[0]].append((r, v))
    for r in got:
        url = urls[r["page_id"]]
        host = plain_verdict(url, [], [])[0]
        near = [x for k in range(len(host)) if not k or host[k - 1] == "." for x in by_host.get(host[k:], [])] if len(host) < 1000 else []
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(url, near, ["casino"]), url


# --- 7 suffix-array dedup


def test_suffix_dedup(spark):
    rng = random.Random(9)
    passage, other = [words(rng, n, 10**6) for n in (60, 51)]
    fresh = lambda n: words(rng, n, 10**6)
    rows = [(k, fresh(200)) for k in range(30)]
    rows += [(100 + k, f"{fresh(rng.randrange(80))} {passage} {fresh(rng.randrange(80))}") for k in range(12)]
    rows += [(200 + k, f"{fresh(20)}\n{other}\t{fresh(20)} {words(rng, 49, 10**6)}") for k in range(2)]
    rows += [(300, "Again " * 300), (400, None), (401, ""), (402, "short text"), (None, passage), (403, fresh(20) + " " + passage.upper())]
    docs = frame(spark, rows).repartition(9)
    spans = suffix_dedup.repeated_passages(docs).collect()
    text = dict(rows)
    assert {r["doc_id"] for r in spans} == {*range(100, 112), 200, 201, 300, 403}
    for r in spans:
        if r["doc_id"] == 300:
            continue
        got = " ".join(text[r["doc_id"]].lower().split()[r["start_word"] : r["start_word"] + r["n_words"]])
        want = other if r["doc_id"] in (200, 201) else passage
        assert got == want and r["kept"] == (r["doc_id"] in (100, 200)) and r["first_doc_id"] == (200 if want == other else 100)
    left = by_id(suffix_dedup.without_passages(docs, suffix_dedup.repeated_passages(docs)).collect(), "text")
    assert len(left) == len(dict(rows)) and passage in left[100][0] and left[5][0] == text[5] and left[400][0] is None
    for k in range(101, 112):
        assert left[k][0].split() == text[k].replace(passage, " ").split()
    assert suffix_dedup.repeated_passages(frame(spark, [])).count() == 0


# --- 8 toxicity


def test_toxicity(spark, sf_dir):
    rng = random.Random(10)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 4 == 0
        rows.append((k, words(rng, 30) + " " + (" ".join(rng.sample(bad, 2)) if toxic else words(rng, 2)) + " " + words(rng, 10)))
        labels.append((k, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, words(rng, 50_000)), (2003, words(rng, 39) + " you 1d1ot sc-um")]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 3 == 1)
    got = by_id(toxicity.toxicity(docs, model).collect(), "score")
    assert len(got) == len(rows) and all(0 <= s <= 1 for (s,) in got.values())
    held = [k for k in range(900) if k % 3 == 1]
    assert np.mean([(got[k][0] >= 0.7) == (k % 4 == 0) for k in held]) > 0.97
    assert got[2003][0] >= got[2002][0]
    nothing = toxicity.fit(docs, marks.limit(0), F.lit(False))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs, nothing).collect())


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


# --- 9 embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + rng.standard_normal(16) * (0.12 if k % 3 else 0.3)).tolist()) for k in range(400)]
    rows += [(500 + k, rows[0][1]) for k in range(30)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] + [1.0] * 15), (604, [None] + [1.0] * 15), (605, [1.0, 2.0]), (606, [2.0, 4.0]), (607, [float("inf")] * 16), (0, rows[0][1]), (None, rows[0][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_groups(vectors, window=16).collect()}
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a, b in itertools.combinations(fine, 2) if len(fine[a]) == len(fine[b]) and cos(fine[a], fine[b]) >= 0.95]
    group = closure(fine, links)
    count = collections.Counter(x for p in links for x in p)
    assert all(got[i] == (count[i], group[i], group[i] == i) for i in fine)
    assert all(got[i] == (0, i, True) for i in (600, 601, 602, 603, 604, 607)) and got[None] == (0, None, False)
    assert embedding_dedup.embedding_groups(vectors.limit(0)).count() == 0


def test_embedding_recall(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in queries.op9_embedding_dedup(spark, sf_dir).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[r["vec_id"]] <= n for r, n in zip(rows, near, strict=True))


# --- 10 Jaccard join


def shingles(text, k):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent", "limit"), [(3, 90, None), (5, 80, 20), (1, 50, 2)])
def test_jaccard_join(spark, k, percent, limit):
    rng = random.Random(12)
    rows = []
    for base in range(25):
        w = words(rng, rng.choice([2, 8, 30, 120, 500]), 60 if base % 5 == 0 else 3000).split()
        for _ in range(rng.choice([1, 3, 8])):
            v = list(w)
            for _ in range(rng.randrange(max(1, len(w) // 40) + 1)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(v)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (907, "only"), (908, "only this"), (909, words(rng, 20_000, 10**6)), (906, "\u00c9 \u00e9 x y z"), (3, rows[3][1]), (None, rows[3][1])]
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = closure(sets, links)
    got = jaccard_join.jaccard_groups(frame(spark, rows), k=k, percent=percent, limit=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), group[r["doc_id"]]), r
    assert jaccard_join.jaccard_groups(frame(spark, [])).count() == 0
