"""Manifest, toxicity and alignment against brute force and on odd rows; bounds of samples."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import alignment, language, manifest, quality_model, registry, toxicity, urlfilter, warc
from rankloom.llm.common import hash_bound, held_out

ODD = [(1, None), (1, None), (2, ""), (None, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (4, " \n\t "), (5, "ü" * 3000 + " \x00 é"), (6, "word")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    clashing = ("leaf", "root", "proof_sha256", "_at", "_tree", "_row", "_x", "_s", "_score", "n_a", "n_links", "groups_sha256", "_links", "_kept", "c0", "k0", "stretch")
    return df.withColumns({c: F.lit(1) for c in clashing}).withColumns({"source": F.when(F.col("doc_id") > 2, "s").cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


# 11 Manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, fold, verified) of (doc_id, source, lang, n_chars, text), straight from the definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            a = i // 16 * 16
            out.append((level[a:i], level[i + 1 : a + 16]))
            i //= 16
        return out

    groups = defaultdict(list)
    for d, source, lang, n, text in rows:
        changed = d is not None and text is not None and crc32(str(d).encode()) % 5 == 0
        groups[source].append((d is not None, d or 0, sha("".join(map(field, (d, source, lang, n, text)))), sha("".join(map(field, (d, source, lang, n, lower(text) if changed else text)))), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (groups[s].sort(key=lambda x: x[:3]), levels([x[2] for x in groups[s]]))[1] for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, claim, d) in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            fold = claim
            for a, b in path:
                fold = sha("".join(a) + fold + "".join(b))
            out.append((d, leaf, trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), fold, fold == top[-1][0]))
    return Counter(out)


def found_manifest(df, **how):
    changed = held_out(F.col("doc_id"), 5, 0)
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = manifest.proofs(df, keep=["doc_id"], claims={"text": text}, changed=changed, **how)
    return Counter(tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize(("n", "sources", "height"), [(1, 1, 3), (17, 1, 1), (700, 3, 1), (700, 40, 2), (1200, 2, 1)])
def test_manifest_of_trees_of_all_heights(spark, n, sources, height):
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.1 else f"s{0 if rng.random() < 0.6 else rng.randrange(sources)}é"[: rng.choice([2, 3, 4])], rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Ab C", "", None, f"Ü{i}"])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found_manifest(df, height=height) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    assert found_manifest(odd) == brute_manifest(rows)
    assert manifest.proofs(odd.limit(0), keep=["doc_id"]).count() == 0
    kept = manifest.proofs(odd, keep=["doc_id", "_at", "_tree", "c0", "leaf", "_kept"], siblings=True)
    assert kept.columns == ["doc_id", "_at", "_tree", "c0", "_kept", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    assert all(r.verified and r["_tree"] == 1 and sha(r.proof) == r.proof_sha256 for r in kept.collect())


def test_missing_nodes_are_the_fewest():
    assert manifest.missing(0, 15, 16) == [] and manifest.missing(0, 0, 1) == []
    assert manifest.missing(0, 3, 6) == [(0, 4), (0, 5)]
    # Leaves 16..47 of 300 make nodes 1 and 2; node 0 and 3..15 are missing there, and above them all but the first.
    assert manifest.missing(16, 47, 300) == [(1, 0), *((1, k) for k in range(3, 16)), (2, 1)]


# 12 Toxicity


def test_readings_of_disguised_words(spark):
    words = "idiot clown stupid trash the a of to and is that good look all tree".split()
    text = " ".join(words * 40)
    rows = [text, "you 1d10t, c10wn", "i d i o t", "s.t.u.p.i.d!", "idiiiiiot and !d!ot", "5tup1d", "good look all tree", "call 12345 at 10:30", None, ""]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    found = {r.stretch: r.reading for r in toxicity.readings(df).collect()}
    assert found == {"1d10t": "idiot", "c10wn": "clown", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "idiiiiiot": "idiot", "!d!ot": "idiot", "5tup1d": "stupid"}
    assert {r.stretch: r.reading for r in toxicity.readings(df, sent=0).collect()} == found  # joined by shuffles instead of broadcasts
    assert toxicity.readings(df.limit(0)).count() == 0


def test_viterbi_finds_the_best_path():
    """All paths of short stretches, scored one by one."""
    rng = random.Random(5)
    counts = {}
    for _ in range(400):
        word = " " + "".join(rng.choice("aiot#") for _ in range(rng.randint(1, 4))) + " "
        for i in range(len(word)):
            for k in range(1, 5):
                if i + k <= len(word):
                    g = toxicity.number(word[i : i + k])
                    counts[g] = counts.get(g, 0) + 1
    total = sum(n for g, n in counts.items() if 0 <= g < 65536)

    def value(symbols):
        score = 0.0
        for i in range(1, len(symbols)):
            p = toxicity.MIX[4] / toxicity.SYMBOLS + toxicity.MIX[3] * counts.get(toxicity.number(symbols[i]), 0) / total
            for k in range(2, 5):
                gram = symbols[max(0, i - k + 1) : i + 1]
                if len(gram) == k and counts.get(toxicity.number(gram[:-1])):
                    p += toxicity.MIX[4 - k] * counts.get(toxicity.number(gram), 0) / counts[toxicity.number(gram[:-1])]
            score += np.log(p)
        return score

    def paths(choices, i):
        if i == len(choices):
            yield "", 0.0
            return
        for text, n, p in choices[i]:
            for rest, q in paths(choices, i + n):
                yield text + rest, p + q

    for stretch in ("1oa", "a0t1", "t.0.1", "iiia", "!000o", "a t 0", "4+@", "x1"):
        best = max(channel + value(" " + "".join(map(toxicity.symbol, out)) + " ") for out, channel in paths(toxicity.lattice(stretch), 0))
        got = toxicity.read(stretch, counts, total)
        assert best == pytest.approx(max(c + value(" " + "".join(map(toxicity.symbol, o)) + " ") for o, c in paths(toxicity.lattice(stretch), 0) if o == got))


def test_counts_of_grams_against_brute_force():
    words, times = ["idiot", "", "aé1x", "b", "ΩΩ", "𝒳a"], np.array([2, 1, 3, 1, 5, 1])
    want = Counter()
    for w, t in zip(words, times.tolist(), strict=True):
        s = " " + "".join(map(toxicity.symbol, w)) + " "
        for i in range(len(s) - 1):
            for k in range(1, 5):
                if i + k <= len(s):
                    want[toxicity.number(s[i : i + k])] += t
    keys, n = toxicity.counted_grams(words, times)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(want)


def test_toxicity_of_disguised_insults(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choice("the a of river stone tree house garden idea tall paint".split()) for _ in range(20)) for _ in range(120)]
    rude = [t + " you idiot" if i % 2 else t + " what a clown" for i, t in enumerate(plain)]
    rows = [(i, t) for i, t in enumerate(plain + rude)]
    tests = [(1000, plain[0] + " 1d10t"), (1001, plain[1] + " c l o w n"), (1002, plain[2] + " idiiiiot"), (1003, plain[3]), (1004, plain[4] + " 12 34")]
    docs = spark.createDataFrame(rows + tests + [(i, t) for i, t in ODD], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i, _ in rows] + [(3000, None)], "doc_id long, toxic int")
    read_as = toxicity.readings(docs)
    weights = toxicity.fit(docs, labels, F.lit(True), read_as)
    got = {r.doc_id: r["_score"] for r in toxicity.scores(docs, weights, read_as, keep=["doc_id"]).collect()}
    assert [got[i] >= 0.5 for i in range(1000, 1005)] == [True, True, True, False, False]
    none = toxicity.fit(docs, labels.limit(0), F.lit(True), read_as)
    assert {r["_score"] for r in toxicity.scores(docs, none, read_as, keep=[]).collect()} == {0.5}


def test_toxicity_of_odd_rows(spark, odd):
    read_as = toxicity.readings(odd)
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    out = toxicity.scores(odd, weights, read_as, keep=["doc_id", "_row", "_x", "_s", "k0", "stretch", "_score"])
    assert out.columns == ["doc_id", "_row", "_x", "_s", "k0", "stretch", "_score"] and out.count() == len(ODD)
    assert all(r["_score"] == 0.5 and r["_x"] == 1 for r in out.collect())
    assert toxicity.scores(odd.limit(0), weights, read_as, keep=["doc_id"]).count() == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() >= 0.95 and found[found.toxic == 0].predicted.sum() == 0


# 13 Alignment


@pytest.fixture(scope="module")
def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return {"byte_path": tokenizers.path("byte_bpe_50k.json"), "piece_path": tokenizers.path("piece_bpe_32k.model")}


def brute_alignment(rows, paths):
    """The contract on whole texts, with the libraries' own calls and loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(paths["byte_path"]), sentencepiece.SentencePieceProcessor(model_file=paths["piece_path"])
    a_model.encode_special_tokens = True
    own = alignment.byte_characters()
    counts, docs = Counter(), []
    for d, text in rows:
        docs.append((d, None))
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        sides = [[bytes(own[c] for c in a_model.id_to_token(i)) for i in a], [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        links = [(a[i], b[j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e > (ends[1][j - 1] if j else 0) and f > (ends[0][i - 1] if i else 0)]
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in both:
            x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            i, j = x, y
        counts.update(links)
        docs[-1] = (d, (len(a), len(b), len(groups), links, sha(";".join(groups))))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return Counter((d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for d, x in docs)


def found_alignment(df, paths, **how):
    out = alignment.alignment(df, keep=["doc_id"], **paths, **how)
    return Counter(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


AWKWARD = ["hello", " two  spaces   here ", "tab\tand\nnew\n\nlines ", "日本語 テキスト です", "naïve café x", "a▁b ▁", "<0x41> <s> <|endoftext|> x", "it's we'll 'S", "é ‍ 👩‍👩‍👧 x", "x\u0085y ᠎ z", "1234567 12,3.4", "\x1c a \x1f", "aaaaaaaaaaaaaaaaaaaaaa bbbbb", "Привет мир", "ﬁ Å ½", "﻿ bom", "a\r\nb"]


def test_alignment_against_brute_force(spark, paths, odd):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdeé ĀΩж 日\n.,'1$\t  ") for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in docs] + [(10_000 + i, t) for i, t in enumerate(AWKWARD + noise)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_alignment(rows, paths)
    assert found_alignment(df, paths) == want
    assert found_alignment(df, paths, most=500) == want  # counted pairs in blocks


def test_alignment_of_odd_rows(spark, paths, odd):
    out = alignment.alignment(odd, keep=["doc_id", "n_a", "_links", "_row", "c0"], **paths)
    assert out.columns == ["doc_id", "_row", "c0", *alignment.Parts.FIGURES, "groups_sha256", "n_best", "count_sum"]
    assert {r.doc_id: r.groups_sha256 for r in out.collect() if r.doc_id in (1, 2)} == {1: "", 2: ""}
    assert alignment.alignment(odd.limit(0), keep=["doc_id"], **paths).count() == 0


def test_products_of_sparse_rows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = (rng.random((rng.integers(1, 6), 5)) < 0.4), (rng.random((5, rng.integers(1, 6))) < 0.4)
        csr = lambda m: alignment.Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], m.shape[1])
        dense = lambda m: {(i, int(j)) for i in range(len(m.indptr) - 1) for j in m.indices[m.indptr[i] : m.indptr[i + 1]]}
        assert dense(csr(a).times(csr(b))) == {(int(i), int(j)) for i, j in zip(*np.nonzero(a.astype(int) @ b.astype(int)), strict=True)}
        assert dense(csr(a).transposed()) == {(int(j), int(i)) for i, j in zip(*np.nonzero(a), strict=True)}
    a, b = alignment.incidence(np.array([2, 1, 3])), alignment.incidence(np.array([1, 2, 2, 1]))
    x, y = alignment.grouped(a, b)
    assert dense(a.times(b.transposed())) == {(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)}
    assert dense(x.times(y.transposed())) == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)}


# Bounds of samples


def test_no_sample_is_empty_at_any_size():
    assert hash_bound(5000, 10) == 2**63 - 1 and hash_bound(5000, 0) == 2**63 - 1
    for size in (10**6, 10**10, 10**15):
        share = (hash_bound(5000, size) + 2**63) / 2**64
        assert share == pytest.approx(5000 / size, rel=1e-6)
    assert hash_bound(1, 10**30) > -(2**63)


def test_a_very_frequent_language_is_still_learned(spark):
    rows = [(i, f"xa xe xi {i % 50}", "xx") for i in range(60_000)] + [(100_000 + i, "yo yu ya", "yy") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), most=40)
    out = language.labelled(spark.createDataFrame([(1, "xa xi xe")], "doc_id long, text string"), model, keep=["doc_id"])
    assert out.first()["_lang"] == "xx"


def test_empty_tables_of_learners(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality_model.fit(docs, labels, F.lit(True))
    assert not weights.any() and quality_model.scores(docs, weights, keep=["doc_id"]).count() == 0
    assert language.labelled(docs, language.learn(docs, F.lit(True)), keep=["doc_id"]).count() == 0


def test_quality_score_against_the_definition(spark):
    """Features by hand: distinct hashed words, pairs, shapes and pairs of shapes, and a dot product."""
    from rankloom.llm.common import WordHashes, mixed, word_hashes

    rng = np.random.default_rng(2)
    weights = rng.normal(size=(1 << quality_model.BITS) + 1).astype(np.float32)
    texts = ["One two two 34!", "", "a", "x" * 40 + " é é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["_score"] for r in quality_model.scores(docs, weights, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        words = t.encode().split()
        w, s = word_hashes(words, WordHashes()).tolist(), [quality_model.Shapes()[x] for x in words]
        m, mask = 0x9E3779B97F4A7C15, 2**64 - 1
        keys = {*w, *s} | {(a * m + b) & mask for side in (w, s) for a, b in zip(side, side[1:])}
        x = {int(mixed(np.array([k], np.uint64))[0]) >> 64 - quality_model.BITS for k in keys}
        score = 1 / (1 + np.exp(-(sum(float(weights[j]) for j in x) / max(1, len(x)) ** 0.5 + float(weights[-1]))))
        assert got[i] == pytest.approx(score, abs=1e-6)


# 5 URL filter


@pytest.mark.parametrize("share_keys", [1, 7, 200_000])
def test_nested_rules_by_the_stack(spark, share_keys):
    rng = random.Random(share_keys)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "org", "a.org", "ba.com"]
    paths = ["", "/", "/x", "/x/y", "/x/yz", "/é", "/x\x7f"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)] + [("COM", "/x", "block"), (None, "/", "allow")]
    urls = [f"http://{rng.choice(['', 'w.', 'b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/y/z', '?k=/x'])}" for _ in range(150)] + [None, "no scheme", "://", "x://COM/x"]
    least = {}
    for h, p, v in rules:
        if h is not None:
            key = (h.lower(), p)
            least[key] = min(v, least.get(key, v))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "label", "share", "at", "c0")})
    places = df.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path")).where("host <> ''").distinct()
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in urlfilter.fitting(places, table, share_keys).collect()}
    for r in places.collect():
        fit = [(len(h + p), h + p, v) for (h, p), v in least.items() if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert got.get((r.host, r.path)) == (max(fit)[1:] if fit else None)
    out = urlfilter.judged(df, table, keep=["page_id", "host", "label", "share", "at", "c0"])
    assert out.columns == ["page_id", "label", "share", "at", "c0", "host", "path", "rule", "verdict"] and out.count() == len(urls)
    assert urlfilter.judged(df.limit(0), table, keep=["page_id"]).count() == 0
    assert {r.rule for r in urlfilter.judged(df, table.limit(0), keep=["page_id"]).collect()} == {None}


# 7 WARC


def test_archive_files_are_bounded_whatever_the_tail(spark, monkeypatch, tmp_path):
    import gzip
    import pathlib

    from rankloom.functions.lineage import new_path

    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    monkeypatch.setattr(warc, "SIZES", (1000, 8000, 64_000))
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, "u", text(rng.choice([10, 900, 5000]))) for i in range(600)] + [(1000 + i, "u", text(50_000)) for i in range(12)] + [(2000 + i, "u", text(300_000)) for i in range(3)]
    rows += [(3000 + i, "v", rows[-1][2]) for i in range(4)] + [(4000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc")
    got = warc.round_trip(df, key="page_id", url="url", payload="html", path=path).collect()
    files = [gzip.decompress(f.read_bytes()) for f in pathlib.Path(path.removeprefix("file:")).rglob("*.gz")]
    assert len(files) > 10 and all(len(f) <= 210_000 or f.count(b"WARC/1.1") == 1 for f in files)
    assert sum(len(f) for f in files) < 4_000_000  # the payload of the copies stands there once
    want = Counter((str(k), len(t or ""), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if k in (2002, 3000, 3001, 3002) else "response", "3003" if k in (2002, 3000, 3001, 3002) else None) for k, _, t in rows)
    assert Counter(map(tuple, got)) == want


def test_verdicts_by_join_where_there_are_many(spark, monkeypatch):
    rows = [(i, "u", "x" * (1000 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = Counter(map(tuple, warc.round_trip(df, key="page_id", url="url", payload="html").collect()))
    monkeypatch.setattr(warc, "SENT", 3)
    assert Counter(map(tuple, warc.round_trip(df, key="page_id", url="url", payload="html").collect())) == one and sum(n for r, n in one.items() if r[3] == "revisit") == 53
