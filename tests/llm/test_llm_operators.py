"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, components, decontaminate, language, licenses, minhash, passages, quality_model, quality_rules, registry, suffix_array, urlfilter, warc
from rankloom.llm.common import held_out, slices
from tests.oracle import same

ODD = [(1, None), (1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, " \n\t "), (5, "ü" * 3000 + " \x00 é"), (6, "word")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("n_words", "lang", "score", "kept", "key", "_x", "_row", "_z", "_loss", "_n_words", "_root")}).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLES[name], sf)


# 1 Byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("long_chars, chunk, overlap", [(32_768, 16_384, 512), (300, 100, 40), (50, 64, 33)])
def test_bpe_equals_the_library_and_round_trips(spark, tokenizer, long_chars, chunk, overlap):
    path, pattern, library = tokenizer
    rows = [*ODD, (7, "a" * 3000 + "  " * 900 + "b's we'll 're" * 50), (8, "'" * 50 + "re" * 100 + "'re " * 400), (9, (" \t\n" * 7 + "word's12 ") * 200), (10, "é漢字\n\n\n x" * 300)]
    how = {"ranks_path": path, "pattern": pattern, "keep": ["doc_id"]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.digests(bpe.encode(df, long_chars=long_chars, chunk=chunk, overlap=overlap, **how), **how).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(df.limit(0), **how).count() == 0


def test_pairs_merge_like_one_word_at_a_time(tokenizer):
    path, pattern, library = tokenizer
    v = bpe.Vocabulary(path, pattern)
    r = random.Random(3)
    words = list({"".join(r.choices("abcde thé漢\n ", k=r.randint(1, 40))) for _ in range(3000)} | {"a", "the" * 200})
    assert [np.frombuffer(x, "<u4").tolist() for x in v.packed.pairs.merged([w.encode() for w in words])] == [bpe.merge(w.encode(), v.ranks) for w in words]
    assert v.packed.pairs.merged([]) == []


def test_bpe_keeps_columns_of_any_name(spark, tokenizer):
    path, pattern, library = tokenizer
    how = {"ranks_path": path, "pattern": pattern, "keep": ["doc_id", "_key", "_text", "_ids", "_run", "n_tokens", "c1"]}
    df = spark.createDataFrame([(1, "one two"), (2, "ab c" * 40)], "doc_id long, text string").withColumns({c: F.lit(c) for c in how["keep"][1:]})
    got = bpe.digests(bpe.encode(df, long_chars=50, chunk=64, overlap=33, **how), **how)
    assert got.columns == ["doc_id", "_key", "_text", "_run", "c1", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {(r.doc_id, r._key, r._text, r.n_tokens) for r in got.collect()} == {(i, "_key", "_text", len(library.encode_ordinary(t))) for i, t in ((1, "one two"), (2, "ab c" * 40))}


# 2 MinHash


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return out


def near_copies(n, seed=5):
    """A text and copies of it with more and more words changed; the text itself is only there edited."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(160)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = word()
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_all_pairs(spark, percent):
    rows = ODD + near_copies(120) + near_copies(3, 9) + [(900, "A b C d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent=percent).collect()]
    assert Counter(got) == Counter(brute_components(rows, percent))


def test_one_of_each_group_stays(spark, odd):
    left = minhash.one_of_each(odd)
    assert left.columns == odd.columns
    assert Counter(map(tuple, left.select("doc_id", "text").collect())) == Counter([r for r in ODD if r != (3, "a b c d e f") and r != (None, "a b c d e f")] + [(3, "a b c d e f")])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_rows_are_dropped_by_a_small_last_plan(spark, odd):
    text = "a b c d e f g h"
    rows = [(5, text, "x"), (5, text, "x"), (5, text, "y"), (None, text, "x"), (None, text, "x"), (7, "p q", "x"), (7, "p q", "x"), (8, "r s", "x")]
    left = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = sorted(map(tuple, left.collect()))
    assert len(found) == 3 and found[0][:2] == (5, text) and found[1:] == [(7, "p q", "x"), (8, "r s", "x")]
    assert minhash.one_of_each(odd)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1


def test_components_of_a_chain_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (50, 51), (51, 50), (None, 3)], "a int, b int")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 51: 50}


# 3 Licenses


def brute_licenses(text):
    w = decontaminate.words_of((text or "").encode())
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        f = decontaminate.words_of(phrase.encode())
        here = [i for i in range(len(w)) if w[i : i + len(f)] == f]
        places += here
        base |= {label} if here else set()
    for template, label in licenses.TEMPLATES:
        t = decontaminate.words_of(template.encode())
        own = set(t)
        needed = 1.0 if len(own) <= licenses.SHORT_WORDS else licenses.THRESHOLD
        for b in range(max(1, len(w) - 2 * len(t) + 1)):
            share = len(own & set(w[b : b + 2 * len(t)])) / len(own)
            if share >= needed - 1e-12:
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score)


def test_licenses_equal_brute_force(spark, docs, texts):
    for r in licenses.scanned(docs, keep=["doc_id"]).collect():
        assert tuple(r)[1:8] == brute_licenses(texts[r.doc_id])
    r = random.Random(12)
    rows = []
    for k in range(150):
        w = decontaminate.words_of(r.choice(licenses.TEMPLATES)[0].encode()) + decontaminate.words_of(r.choice(licenses.TEMPLATES)[0].encode())[: r.randint(0, 30)]
        w = [x for x in w if r.random() > 0.12]
        for _ in range(r.randint(0, len(w))):  # drawn out by other words
            w.insert(r.randint(0, len(w)), b"x")
        rows.append((k, " ".join(["y"] * r.randint(0, 60) + [x.decode() for x in w] + ["z"] * r.randint(0, 60))))
    got = {x.doc_id: tuple(x)[1:8] for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    want = {k: brute_licenses(t) for k, t in rows}
    assert got == want and len({x[5] for x in want.values()}) > 5


def test_neighbouring_licenses_keep_their_own_labels(spark):
    rows = [(1, "released under the Apache License", "apache"), (2, "released under the BSD license", ""), (3, "So it was: Released under the MIT License.", "mit"), (4, "Licensed under CC BY 4.0", ""), (5, "Licensed under the Mozilla Public License, Version 2.0", "")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, want string").withColumn("score", F.lit("x")), keep=["doc_id", "want", "score"]).collect()}
    assert {i: got[i].labels for i, *_ in rows} == {i: x for i, _, x in rows}
    assert got[3].blocks == "mit:3:8" and got[1].blocks == ""


def test_licenses_on_odd_rows(spark, odd):
    assert licenses.scanned(odd, keep=["doc_id"]).where("n_base > 0 OR score > 0").count() == 0
    whole = spark.createDataFrame([(1, "x " * 50 + licenses.TEMPLATES[1][0])], "doc_id long, text string")
    assert licenses.scanned(whole, keep=["doc_id"]).first().labels == "mit"
    assert licenses.scanned(odd.limit(0), keep=["doc_id"]).count() == 0


# 4 Language


def test_viterbi_is_exact_however_texts_are_cut():
    r = np.random.default_rng(1)
    many = r.normal(0, 3, (40, 300)).astype(np.float32)
    label, value, back = language.viterbi(many, np.array([0]), np.array([40]), 2.0), many[0].astype(float), []
    for row in many[1:]:
        back.append(np.where(value >= value.max() - 2, np.arange(300), value.argmax()))
        value = np.maximum(value, value.max() - 2) + row
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    assert label.tolist() == path[::-1] and max(path) > 255
    for _ in range(150):
        k = int(r.integers(1, 5))
        size = r.integers(0, 7, size=r.integers(1, 5))
        scores = r.normal(0, 3, (size.sum(), k)).astype(np.float32)
        begin = np.cumsum(size) - size
        label = language.viterbi(scores, begin, size, 2.0, stretch=int(r.integers(1, 6)))
        for b, n in zip(begin, size):
            value = lambda path: sum(float(scores[b + i, x]) for i, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
            if n:
                assert value(label[b : b + n].tolist()) == pytest.approx(max(map(value, itertools.product(range(k), repeat=int(n)))), abs=1e-3)


def test_language_on_held_out_documents(spark, sf, docs):
    got = registry.op4_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc32(str(i).encode()) % 3 == 1)).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95


def test_predictions_equal_brute_force(spark, docs):
    """Words, hashed trigrams, scripts and the best path by plain loops."""
    model = language.learn(docs, F.lit(True))
    names, table, uses = model
    letter, inside, small, script = language.characters()
    texts = [t.text[:400] for t in docs.where("length(text) > 50").orderBy("doc_id").limit(12).collect()] + ["слово і слово", "a1b 漢字 x", "e\u0301te"]

    def predicted(t):
        words, now = [], []
        for c in map(ord, t + " "):
            if (inside[c] if now else letter[c]):
                now.append(c)
            elif now:
                words.append(now)
                now = []
        scores = []
        for w in words:
            padded = [language.EDGE, *(int(small[c]) for c in w), language.EDGE]
            total = np.zeros(len(names))
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                total += table[:, h >> (32 - language.BITS)]
            own = np.bincount(script[w]).argmax() if len(set(script[w].tolist())) > 1 else script[w[0]]
            scores.append(np.where(uses[:, own], total, total.min() - 50))
        if not words:
            return "und"
        paths = [(scores[0][k], [k]) for k in range(len(names))]
        for x in scores[1:]:
            best = max(paths, key=lambda p: p[0])
            paths = [(x[k] + max(p[0], best[0] - language.SWITCH), (p[1] if p[0] >= best[0] - language.SWITCH else best[1]) + [k]) for k, p in enumerate(paths)]
        share = np.zeros(len(names))
        for k, w in zip(max(paths, key=lambda p: p[0])[1], words):
            share[k] += len(w)
        return names[int(share.argmax())]

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r._lang for r in language.labelled(rows, model, keep=["doc_id"]).collect()} == {i: predicted(t) for i, t in enumerate(texts)}


def test_language_spans_and_odd_rows(spark, docs, odd):
    model = language.learn(docs, F.lit(True))
    en, de = (docs.where(f"lang = '{x}' AND length(text) > 400").orderBy("doc_id").first().text[:300] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en + " " + de), (2, "123 ! —"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.labelled(mixed, model, keep=["doc_id"]).collect()}
    assert {s.split(":")[0] for s in got[1]._spans} == {"en", "de"} and len(got[1]._spans) == 2
    assert (got[2]._lang, got[2]._score, got[3]._lang) == ("und", 0.0, "und")
    assert language.labelled(odd, model, keep=["doc_id"]).count() == len(ODD)
    assert language.learn(odd, F.lit(True))[0] == []
    assert {r._lang for r in language.labelled(odd, language.learn(odd, F.lit(True)), keep=["doc_id"]).collect()} == {"und"}


# 5 URLs


def test_url_rules_equal_brute_force(spark):
    r = random.Random(2)
    rules = [("com", "", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("com", "/x", "block"), ("b.a.com", "", "block"), ("b.a.com", "", "allow"), ("org", "/ü", "block")]
    urls = [None, "", "no scheme", "http://", "x://COM", "http://a.com.?q", "http://.com/x"]
    urls += [f"http://{'.'.join(r.choices(['a', 'b', 'com', 'org', 'xcom'], k=r.randint(1, 4)))}{r.choice(['', '/', '/x', '/x/y/z', '/xy', '/ü#f', '?/x'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("top", F.lit(1))
    got = urlfilter.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string"), keep=["page_id"], default="none").collect()
    assert len(got) == len(urls)
    best = {}
    for h, p, v in sorted(rules, reverse=True):
        best[h, p] = v  # the smallest verdict
    for row in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[row.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "none")
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, *want)


# 6 Quality model


def test_quality_scores_separate_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op6_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9 and held.predicted[held.quality == 1].mean() > 0.95


def test_leader_equals_the_update_rule_by_hand(spark):
    """Follow-the-regularised-leader, one coordinate and one row at a time."""
    q = quality_model
    rows = [(i, i % 2, sorted({(i * 7 + j * j) % 23 for j in range(1 + i % 5)})) for i in range(40)]
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)
    leader = q.Leader(np.zeros(24))
    for _, y, x in rows:
        value = {**{i: 1 / math.sqrt(len(x)) for i in x}, 23: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in value.items())))
        before = {i: weight(i) for i in value}
        for i, v in value.items():
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
            z[i] += g - sigma * before[i]
            n[i] += g * g
        leader.learn(np.array([*x, 23]), y)
    assert leader.weights(np.arange(24)).tolist() == pytest.approx([weight(i) for i in range(24)], abs=1e-12)
    # A start at given weights, as after each epoch, keeps them where nothing is learned.
    again = q.Leader(leader.weights(np.arange(24)))
    assert again.weights(np.arange(24)) == pytest.approx(leader.weights(np.arange(24)), abs=1e-12)


def test_scores_are_sparse_dot_products(spark):
    rows = [(1, "A b, a b 12"), (2, ""), (3, None), (4, "Ünder the été the")]
    weights = np.random.default_rng(2).normal(0, 1, (1 << quality_model.BITS) + 1)
    got = {r.doc_id: r._score for r in quality_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), weights, keep=["doc_id"]).collect()}
    for i, t in rows:
        x = quality_model.features((t or "").encode(), quality_model.WordHashes(), quality_model.Shapes())
        w = weights.astype(np.float32).astype(float)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(w[k] for k in x) / math.sqrt(max(1, len(x))) + w[-1]))), abs=1e-6)


def test_quality_model_on_odd_rows(spark, odd):
    none = spark.createDataFrame([(1, None), (77, 1)], "doc_id long, quality int")
    weights = quality_model.fit(odd, none, F.lit(True))
    assert {r._score for r in quality_model.scores(odd, weights, keep=["doc_id"]).collect()} == {0.5}


# 7 WARC


def test_warc_round_trip(spark):
    big, other = "x" * 1200, "é\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(1, "http://a/1", big), (9, "http://a/9\r\nX: y", big), (4, None, big), (2, "u", other), (3, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", other), (7, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(0), "payload": F.lit("p"), "id": F.lit(1)})
    got = warc.round_trip(df, key="page_id", url="url", payload="html").collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    to = {big: "9", other: "7"}
    want = [(None if k is None else str(k), len((t or "").encode()), sha(t), "revisit" if t in to and str(k) != to[t] else "response", to[t] if t in to and str(k) != to[t] else None) for k, _, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.round_trip(df.limit(0), key="page_id", url="url", payload="html").count() == 0


def test_archives_of_others_are_read():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore"
    data = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    data += b"WARC/1.0\r\nwarc-type:response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:ABC234\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (info, fields), (head, payload) = warc.parsed(data)
    assert (info["warc-type"], fields, head["warc-type"], payload) == ("warcinfo", b"a: b", "response", b"body\r\n\r\nmore")


# 8 Repeated passages


def brute_passages(rows, n):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for (k, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((k, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def test_passages_equal_brute_force(spark):
    r = random.Random(3)
    w = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    p = [w(60) for _ in range(4)]
    rows = [*ODD[:4], (3, "a" * 500), (4, "ab" * 300), (5, p[0] + w(50) + p[1]), (6, w(20) + p[0]), (7, p[2] + p[2]), (8, w(39)), (9, p[3][:40]), (10, w(5) + p[3][:40]), (11, "x" * 39), (12, "x" * 39), (14, p[1] * 30)]
    rows += [(13, w(100))] * 2 + [(100 + i, p[0][:45] + w(10)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("digest", "spans", "hash", "_z", "_size", "n_copies", "c0")})
    assert Counter(map(tuple, passages.digests(df, keep=["doc_id"], length=40).collect())) == Counter(brute_passages(rows, 40))
    left = passages.deduplicated(df, length=40)
    assert left.columns == df.columns and left.count() == len(rows) and left.where("doc_id = 14").first().text == ""
    assert passages.digests(df.limit(0), keep=["doc_id"], length=40).count() == 0


def brute_words(rows, n, length):
    """The texts without windows of n words or `length` bytes that stand twice."""
    data = [(t or "").encode() for _, t in rows]
    at = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", d)] for d in data]
    grams = [[tuple(d[a:b] for a, b in x[i : i + n]) for i in range(len(x) - n + 1)] for d, x in zip(data, at)]
    seen = Counter(g for x in grams for g in x)
    seen_bytes = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, x, own in zip(data, at, grams):
        gone = bytearray(len(d))
        for a, b in [(x[i][0], x[i + n - 1][1]) for i, g in enumerate(own) if seen[g] > 1] + [(i, i + length) for i in range(len(d) - length + 1) if seen_bytes[d[i : i + length]] > 1]:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(d, gone) if not g).decode(errors="ignore"))
    return out


def test_passages_of_51_words_go_however_short(spark):
    import corpus_pipeline

    r = random.Random(8)
    w = lambda n, k=5: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, k))) for _ in range(n))
    p = [w(51, 3), w(50, 3), w(60), w(30, 30)]
    rows = [(1, w(9) + " " + p[0] + " " + w(7)), (2, p[0].replace(" ", "\n", 3) + "  " + w(5)), (3, w(4) + " " + p[1] + " " + w(4)), (4, p[1]), (5, f"{p[2]} {w(3)} {p[2]}"), (6, "x" + p[3] + "y"), (7, w(3) + p[3]), (8, "a " * 53), (9, w(51)), (10, p[0][1:]), (11, ""), (12, None)]
    q = w(51, 3)
    rows += [(20, "b " * 60), (21, "b " * 60), (30, p[0] + " " + q), (31, q + " " + w(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert [got[i] or "" for i, _ in rows] == brute_words(rows, 51, 400)
    assert got[12] is None and p[0] not in got[1] and p[1] in got[3]


def test_large_shares_are_dealt_again(monkeypatch):
    r = random.Random(4)
    pieces = list({bytes(r.choice(b"ab") for _ in range(r.randint(40, 90))) for _ in range(200)})
    monkeypatch.setattr(passages, "SHARE_BYTES", 200)
    seen = Counter(p[i : i + 40] for p in pieces for i in range(len(p) - 39))
    assert [x.tolist() for x in passages.large_share(pieces, passages.Way(40), 1)] == [[seen[p[i : i + 40]] > 1 for i in range(len(p) - 39)] for p in pieces]
    words = [bytes(r.choice(b"ab") for _ in range(7 * r.randint(8, 20))) for _ in range(30)] + [b"a" * 7 * n for n in range(8, 40)]
    seen = Counter(p[i : i + 56] for p in words for i in range(0, len(p) - 55, 7))
    assert [x.tolist() for x in passages.large_share(words, passages.Way(56, 7), 1)] == [[seen[p[i : i + 56]] > 1 for i in range(0, len(p) - 55, 7)] for p in words]


def test_repeated_words_are_counted(spark):
    r = random.Random(11)
    w = lambda n: " ".join(r.choices(["a", "bé", "ccc", "dd"], k=n))
    p = [w(60), w(12), w(30)]
    rows = [(1, f"{w(9)} {p[1]} {w(3)}"), (2, p[1].replace(" ", "\n ", 3)), (3, f"{p[2]} {w(4)} {p[2]}"), (4, p[0]), (5, p[0]), (6, " " + p[0]), (7, w(11)), (8, "a " * 12), (9, "a " * 11), (10, None), (11, "")]
    words = {k: (t or "").split() for k, t in rows}
    seen = Counter(tuple(x[i : i + 12]) for x in words.values() for i in range(len(x) - 11))
    want = {k: len({j for i in range(len(x) - 11) if seen[tuple(x[i : i + 12])] > 1 for j in range(i, i + 12)}) for k, x in words.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_bytes": F.lit(1), "digest": F.lit(2)})
    got = passages.digests(df, keep=["doc_id", "n_bytes", "digest"], length=400, words=12)
    assert got.columns == ["doc_id", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"]
    assert {x.doc_id: x.n_repeated_words for x in got.collect()} == want


def test_suffix_array_equals_sorting():
    r = random.Random(1)
    for _ in range(150):
        s = bytes(r.choice(r.choice([b"a", b"ab", b"\x00\xff", bytes(range(256))])) for _ in range(r.randint(1, 120)))
        s = s + s[: len(s) // 2] + s if r.random() < 0.5 else s
        depth = r.choice([5, 20, 1000])
        order = suffix_array.suffix_array(np.frombuffer(s, np.uint8), depth).tolist()
        assert sorted(order) == list(range(len(s))) and [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(len(s)))


# 9 Quality rules


def test_measures_equal_brute_force(docs, texts):
    for r in quality_rules.rules(docs, keep=["doc_id"]).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count = Counter(grams)
        covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_rules_reject_noise_and_keep_prose(spark, docs, odd):
    noise = [(9000 + i, " ".join("".join(random.Random(i * 99 + j).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for j in range(60)), "en") for i in range(3)]
    mixed = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality_rules.rules(mixed, keep=["doc_id"]).collect()}
    assert not any(got[i].kept for i, *_ in noise)
    assert sum(r.kept for r in got.values()) > 0.85 * len(got)
    assert quality_rules.rules(odd.select("doc_id", "text", "lang"), keep=["doc_id"]).where("kept").count() == 0
    assert quality_rules.accepted(odd).columns == odd.columns and quality_rules.accepted(odd.limit(0)).count() == 0


def brute_losses(rows, fold):
    """Mean nats per code point by modified Kneser-Ney 5-grams of the other fold; rows of one language."""
    n = quality_rules.ORDER
    padded = {k: quality_rules.EDGE * (n - 1) + t.replace("\0", "\uffff") for k, t in rows}
    grams = {k: [x[i : i + n] for i in range(len(x) - n + 1)] for k, x in padded.items()}
    out = {}
    for m in (0, 1):
        orders = [Counter(g for k, x in grams.items() if fold[k] == m for g in x)]
        for _ in range(n - 1):
            orders.insert(0, Counter(g[1:] for g in orders[0]))
        below = lambda g, types=len(orders[0]): 1 / (types + 1)
        for c in orders:
            of = [sum(v == i for v in c.values()) for i in range(5)]
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
            d = [0.0, *(min(i, max(0.0, i - (i + 1) * y * of[i + 1] / of[i])) if of[i] else 0.5 for i in (1, 2, 3))]
            after = {}
            for g, v in c.items():
                after.setdefault(g[:-1], []).append(v)

            def below(g, c=c, d=d, after=after, lower=below):
                near = after.get(g[:-1])
                return lower(g[1:]) if near is None else (max(c[g] - d[min(c[g], 3)], 0) + sum(d[min(v, 3)] for v in near) * lower(g[1:])) / sum(near)

        for k, x in grams.items():
            if fold[k] != m and x:
                out[k] = -sum(math.log(max(below(g), 1e-12)) for g in x) / len(x)
    return out


def test_losses_equal_brute_force_however_large_the_model_is(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(["the", "cat", "слово", "漢字", "x,", "é", "\0", "😀"], k=r.randint(1, 40))), lang) for first, lang, n in ((1000, "en", 26), (2000, "ru", 26), (3000, "zh", 1)) for i in range(first, first + n)]
    df = spark.createDataFrame([*rows, (1, None, "en"), (2, "", None), rows[0]], "doc_id long, text string, lang string")
    fold = {x.doc_id: x.fold for x in df.select("doc_id", quality_rules.fold_of(F.col("text")).alias("fold")).collect()}
    want = {}
    for lang in ("en", "ru"):
        own = [(i, t) for i, t, x in rows if x == lang]
        want |= brute_losses(own + [(-1, own[0][1])] * (lang == "en"), fold | {-1: fold[own[0][0]]})
    del want[-1]
    assert len(want) == 52
    monkeypatch.setattr(quality_rules, "BUFFER", 50)
    for how in ({}, {"most": 0, "group_bytes": 300}):
        found = quality_rules.scored(df, keep=["doc_id"], text="text", lang="lang", **how).collect()
        assert len(found) == len(rows) + 3
        for x in found:
            assert x._loss == (pytest.approx(want[x.doc_id], abs=1e-5) if x.doc_id in want else None)


def test_model_counts_travel_as_numbers_in_few_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the cat sat on mat {i} \U0010ffff", "en" if i % 2 else None) for i in range(20)], "doc_id long, text string, lang string")
    counts = quality_rules.count_ngrams(df, "text", "lang")
    assert {kind for _, kind in counts.dtypes} == {"bigint"}
    texts = {(r.doc_id, r.text) for r in df.collect()}
    assert counts.agg(F.sum(F.col("c0") + F.col("c1"))).first()[0] == sum(len(t) for _, t in texts)
    ends = {r.near % 2**21 for r in counts.select("near").collect()}
    assert ends == {ord(c) for _, t in texts for c in t}
    tables = []
    written = quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda df, *a: tables.append(df) or written(df, *a))
    assert quality_rules.model(df, "text", "lang").count() == counts.count() and len(tables) <= 5


def test_counts_are_added_up_column_by_column():
    r = np.random.default_rng(3)
    tracemalloc.start()
    try:
        keys = [r.integers(0, 150_000, 50_000).astype(np.uint64) for _ in range(10)]
        held = [(k, np.ones(len(k), np.int64), *((k * np.uint64(m)).astype(np.int64) for m in (3, 5, 7))) for k in keys]
        want = np.unique(np.concatenate(keys), return_counts=True)
        del keys
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        ((key, n, *others),) = quality_rules.added_up(held)
        assert tracemalloc.get_traced_memory()[1] < 1.8 * before
    finally:
        tracemalloc.stop()
    assert not held and (key == want[0]).all() and (n == want[1]).all()
    assert all((x == key.astype(np.int64) * m).all() for x, m in zip(others, (3, 5, 7), strict=True))


def test_limits_of_languages_are_written(spark):
    rows = [(lang, v) for lang, n in (("a", 5), ("b", 2), ("c", 0)) for v in [None, *(float(i * i) for i in range(n))]]
    limits = quality_rules.bands(spark.createDataFrame(rows, "_lang string, _loss double"))
    # medians 4 and 0.5, medians of the deviations 4 and 0.5
    want = {"a": (4 - 6 * 1.4826 * 4, 4 + 6 * 1.4826 * 4), "b": (0.5 - 6 * 1.4826 * 0.5, 0.5 + 6 * 1.4826 * 0.5)}
    assert {r[0]: (r[1], r[2]) for r in limits.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    plan = limits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_rules_reject_noise_in_other_scripts_and_salad(spark):
    r = random.Random(7)
    letters = {"ru": "абвгдежзиклмнопрстуфхцчшыьэюя", "en": "abcdefghijklmnoprstuvwyz"}
    rows, bad = [], set()
    for lang, chars in letters.items():
        word = lambda: "".join(r.choices(chars, k=r.randint(2, 9)))  # noqa: E731, B023
        phrases = [[word() for _ in range(6)] for _ in range(60)]
        for i in range(120):
            w = [x for p in r.choices(phrases, k=r.randint(12, 25)) for x in p]
            if i < 3:
                bad.add(len(rows))
                w = [word() for _ in w] if lang == "ru" else r.sample(w, len(w))
            rows.append((len(rows), " ".join(w) + ".", lang))
    got = {x.doc_id: x.kept for x in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=["doc_id"]).collect()}
    assert not any(got[i] for i in bad) and sum(got.values()) >= 0.95 * (len(rows) - len(bad))


# 10 Decontamination


def test_blocks_of_patterns_and_odd_items(spark, docs, odd):
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "word"), (None, "ü é"), (5, " ".join(str(i) for i in range(15)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd.unionByName(spark.createDataFrame([(50, " ".join(str(i) for i in range(3, 30)))], "doc_id long, text string"), allowMissingColumns=True)
    df = df.withColumns({c: F.lit(1) for c in ("_whole", "_size0", "digest", "runs", "text_", "_n_words", "n_hit")})
    one, many = (sorted(map(tuple, decontaminate.digests(decontaminate.contamination(df, bench, keep=["doc_id", "_whole", "digest", "runs", "_n_words", "n_hit"], block_words=b), ["doc_id"]).collect()), key=str) for b in (10_000, 1))
    kept = decontaminate.contamination(df, bench, keep=["doc_id", "_whole", "digest", "_n_words"], block_words=1)
    assert kept.columns == ["doc_id", "_whole", "digest", "_n_words", "_runs", "_items"] and kept.where("_whole = 1 AND digest = 1").count() == df.count()
    assert one == many
    by = {r[0]: r for r in one}
    assert by[50][2:4] == (12, 1) and by[6][2:4] == (1, 1) and by[3][2:4] == (6, 1) and by[1][1:4] == (0, 0, 0)
    assert decontaminate.digests(decontaminate.contamination(df, bench.limit(0), keep=["doc_id"]), ["doc_id"]).where("contaminated").count() == 0


# Pipeline and helpers


def test_pipeline_stage_by_stage(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "byte_level_bpe"]
    rows = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf).collect()
        kept = {r.doc_id: r for r in out}
        before = {r.doc_id: r for r in rows.collect()}
        assert set(kept) <= set(before) and len(kept) == len(out)
        if k == 0:
            want = {r.doc_id for r in quality_rules.rules(rows, keep=["doc_id"]).where("kept").collect()}
        elif k == 1:
            want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before.values()], 80) if i == c}
        elif k == 2:
            want = set(before)
            assert [r.text for r in sorted(out, key=lambda r: r.doc_id)] == brute_words(sorted((r.doc_id, r.text) for r in before.values()), 51, 400)
        elif k == 3:
            bad = decontaminate.digests(decontaminate.contamination(rows, spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"]), ["doc_id"]).where("contaminated").collect()
            want = set(before) - {r.doc_id for r in bad}
        else:
            want = set(before)
        assert set(kept) == want
        if k < 4:
            rows = spark.createDataFrame(out, docs.schema)
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in out)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_slices_cover_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20), None, "", "y"] * 9)], names=["t"])
    assert [t for _, part in slices(batch) for t in part] == [b"x" * (1 << 20), b"", b"", b"y"] * 9
    assert held_out(F.lit(1), 3, 1) is not None
