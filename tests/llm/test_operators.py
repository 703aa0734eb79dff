"""Every operator against its plain version, with nulls, empty and long texts, ties, repeats, and clashing extra columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspark.llm import (
    components,
    decontaminate,
    embedding_dedup,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    ngram_jaccard,
    piece_bpe,
    registry,
    secret_scan,
    stash,
    suffix_dedup,
    textkit,
)

from . import brute

EXTRA = "id string, n string, u string, key string, _t string, h string, blob string, spans string"


def frame(spark, rows):
    """doc_id, text and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.select("*", *(F.lit("clash").alias(c.split()[0]) for c in EXTRA.split(", ")))


def by_id(df, *columns):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[c] for c in columns) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "Été", "theta", "iota", "kappa", "lambda", "straße"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 80]))) for _ in range(12)]

    def edited(t):
        w = t.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(k, edited(rng.choice(base)) + rng.choice(["", "\n" + rng.choice(base)])) for k in range(160)]
    rows += [(200 + k, base[3]) for k in range(40)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "="*700), (905, "="*650), (906, "x" * 5000 + " " + base[0]), (907, "é" * 90), (908, "é" * 60)]
    return rows


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.u: r.v for r in components.connected_components(edges, stash.Stash(spark, "t")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components.connected_components(edges.limit(0), stash.Stash(spark, "t")).count() == 0


def test_words():
    raw = "Ab cD\x0b\x0cé-x".encode()
    buf = np.frombuffer(raw, np.uint8)
    ws, we, doc = textkit.word_spans(buf, np.array([0, 3, len(raw)]), textkit.SPACED)
    assert [raw[a:b].decode() for a, b in zip(ws, we)] == ["Ab", "cD", "é-x"] and doc.tolist() == [0, 1, 1]


def test_hashes():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(20), 100, 1000]] + [x.encode() for n in (1024, 4096) for x in thue_morse("a", "b", n)] + [b"\0" * n for n in range(1, 20)]
    size = np.array([len(p) for p in parts])
    buf = np.frombuffer(b"".join(parts), np.uint8)
    h = textkit.span_hashes(buf, np.cumsum(size) - size, size)
    assert len(set(h.tolist())) == len(set(parts))
    alone = [textkit.span_hashes(np.frombuffer(p, np.uint8), np.zeros(1, int), np.array([len(p)]))[0] for p in parts]
    assert alone == h.tolist()
    assert not set(h.tolist()) & set(textkit.span_hashes(buf, np.cumsum(size) - size, size, 1).tolist())


def test_suffix_dedup(spark, texts):
    got = by_id(suffix_dedup.remove_repeats(frame(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(texts)
    assert suffix_dedup.remove_repeats(frame(spark, texts).limit(0)).count() == 0
    twice = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "q" * 60), (1, "q" * 60)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_earlier_matches():
    text = np.frombuffer(b"abababab" * 9, np.uint8)
    string, at = suffix_dedup.earlier_matches(text, np.array([0, 24, 48]), np.array([24, 24, 24]), np.array([5, 2, 9]), np.array([1, 1, 1]), 10)
    assert set((string * 24 + at).tolist()) == set(range(0, 15)) | set(range(48, 63))
    rng = random.Random(5)
    for trial in range(40):
        words = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randint(1, 9))) for _ in range(5)]
        strings = [b"".join(rng.choice(words) for _ in range(rng.randint(1, 9)))[:84] for _ in range(rng.randint(1, 40))]
        doc = [rng.randint(-3, 12) for _ in strings]
        key = [rng.randint(0, 2) for _ in strings]
        size = np.array([len(t) for t in strings])
        got = suffix_dedup.earlier_matches(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, np.array(doc), np.array(key), 7)
        want = [(k, p) for k, t in enumerate(strings) for p in range(len(t) - 6) if any(key[j] == key[k] and doc[j] < doc[k] and t[p : p + 7] in u for j, u in enumerate(strings))]
        assert list(zip(*(x.tolist() for x in got))) == want


def test_index_gets_only_what_may_match(monkeypatch):
    """Contexts that share too little are ruled out without loss, and found windows are not indexed again level by level."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    shared = [word(n) for n in (16, 30, 45, 50, 51, 60, 84, 120)]
    docs = [b"".join(word(rng.randint(0, 70)) + rng.choice(shared) for _ in range(6)) for _ in range(60)]
    size = np.array([len(t) for t in docs])
    buf, off = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum(size)])
    c = suffix_dedup.Contexts(buf, off)
    first, count = c.p0, c.p1 - c.p0 + 1
    own = [[bytes(buf[first[x] + p : first[x] + p + 50]) for p in range(count[x])] for x in range(len(first))]
    holders = {}
    for x, windows in enumerate(own):
        for w in windows:
            holders.setdefault(w, set()).add(c.doc[x])
    _, of = np.unique(c.key, return_inverse=True)
    several, kept = (np.bincount(of)[of] > 1).sum(), []
    for cores in (3, 35):
        found = suffix_dedup.shared_windows(buf, first, count, c.q - c.p0, c.key, c.doc, cores)
        reach = {x: (a, a + m) for x, a, m in zip(*(v.tolist() for v in found))}
        for x, windows in enumerate(own):
            hit = [p for p, w in enumerate(windows) if len(holders[w]) > 1]
            assert not hit or reach[x][0] <= hit[0] and hit[-1] < reach[x][1]
        kept.append(len(reach))
    assert kept[1] <= kept[0] < several

    rows = []

    class Counted(suffix_dedup.RunLengthIndex):
        def __init__(self, *a):
            super().__init__(*a)
            rows.append(self.rows)

    monkeypatch.setattr(suffix_dedup, "RunLengthIndex", Counted)
    base = word(84)
    texts = [base[a : a + 60] for a in range(3)] * 88
    size = np.array([len(t) for t in texts])
    string, _ = suffix_dedup.earlier_matches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, np.arange(len(texts)), np.zeros(len(texts), np.int64), 50)
    assert np.bincount(string, minlength=len(texts)).tolist() == [0, 10, 10] + [11] * (len(texts) - 3)
    assert sum(rows) < 2 * size.sum()


def test_matching_statistics():
    """Streamed lengths equal those by substring tests, group by group, over fewer runs than rows."""
    rng = random.Random(6)
    base = "".join(rng.choice("abc") for _ in range(60))
    texts = [base[rng.randint(0, 9) : rng.randint(30, 60)].replace("a", rng.choice("aab"), 1).encode() for _ in range(80)]
    group = np.array([rng.randint(0, 2) for _ in texts])
    size = np.array([len(t) for t in texts])
    flat, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    low = np.arange(50)
    index = suffix_dedup.RunLengthIndex(flat, first[low], size[low], group[low])
    assert len(index.key) < index.rows / 4
    for place, live, long in index.matching_statistics(flat, first[50:], size[50:], group[50:]):
        for q, n in zip(live.tolist(), long.tolist()):
            tail = texts[50 + q][place:]
            assert n == max(m for m in range(len(tail) + 1) if any(group[j] == group[50 + q] and tail[:m] in texts[j] for j in range(50)))


def test_jaccard(spark, texts):
    got = by_id(ngram_jaccard.jaccard_classes(frame(spark, texts)), "n_shingles", "component_id")
    assert got == brute.jaccard(texts)
    assert ngram_jaccard.jaccard_classes(frame(spark, texts).limit(0)).count() == 0


def test_jaccard_of_long_words(spark):
    rows = [(10 * k + j, f"one two {w} four five") for k, n in enumerate((1024, 2048, 8192)) for j, w in enumerate(thue_morse("a", "b", n))]
    got = by_id(ngram_jaccard.jaccard_classes(frame(spark, rows)), "n_shingles", "component_id")
    assert got == {i: (1, i) for i, _ in rows}


def test_jaccard_families(spark, monkeypatch):
    """Large groups of near copies, some of which only reach each other over others."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    want = brute.jaccard(rows)
    assert len({c for _, c in want.values()}) > 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(ngram_jaccard.jaccard_classes(df), "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_jaccard, "MOST_FAMILY", 5)  # the way for families that are too large for a task
    assert by_id(ngram_jaccard.jaccard_classes(df), "n_shingles", "component_id") == want


def test_jaccard_sketches():
    """Sketches never say that sets differ by more than they do, at equal and at folded lengths, and tell random sets apart."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 60, 64, 65, 90, 128, 129, 500, 513, 700, 5000):
        own = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate([own[n // 8 :], rng.integers(0, 2**64, n // 8, dtype=np.uint64)]))]
    drawn = ngram_jaccard.Sketches([ngram_jaccard.sketch(s) for s in sets])
    i, j = (v.ravel() for v in np.indices((len(sets), len(sets))))
    for a, b, bits in zip(i.tolist(), j.tolist(), drawn.apart(i, j).tolist()):
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert bits <= apart and (apart - bits) % 2 == 0
        n, m = sorted((len(sets[a]), len(sets[b])))
        if a // 2 != b // 2 and n >= 60 and 4 * n >= 3 * m:
            assert 7 * bits > n + m


def test_jaccard_shared_passages(spark, monkeypatch):
    """Documents that share rare passages but cannot be links form no family, and of the texts only wanted ones are passed on."""
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(k, passage + " " + " ".join(f"d{k}w{j}" for j in range(40))) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)

    def no_family(*_):
        raise AssertionError("no pair is open")

    monkeypatch.setattr(ngram_jaccard, "_family", no_family)
    assert by_id(ngram_jaccard.jaccard_classes(df), "n_shingles", "component_id") == {k: (51, k) for k, _ in rows}
    ids = spark.createDataFrame([(3,), (17,), (17,), (99,)], "id long")
    out = ngram_jaccard._texts(df.toDF("id", "text"), ids)
    assert sorted(r[0] for r in out.collect()) == [3, 17]


def test_jaccard_rounds(spark, monkeypatch):
    """A family that is too large for a task goes by rounds, and components that the nearest pairs do not join get all pairs."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = base[: 75 + k % 3 * 30]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rounds, plain = [], ngram_jaccard._cross

    def counted(num, den, most):
        rounds.append(most)
        return plain(num, den, most)

    monkeypatch.setattr(ngram_jaccard, "MOST_FAMILY", 3)
    monkeypatch.setattr(ngram_jaccard, "_cross", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(ngram_jaccard.jaccard_classes(df), "n_shingles", "component_id") == brute.jaccard(rows)
    assert rounds[:2] == [1, ngram_jaccard.WIDER]


def test_licenses(spark, texts):
    rows = texts + [(950, "Released under the MIT License."), (951, "x CC BY-NC 4.0, see GNU General Public License! mit license"), (952, "Permission is hereby granted, free of charge"), (953, "licensed under the Apache License, Version 2.0")]
    out = license_scan.scan_licenses(frame(spark, rows))
    assert by_id(out, "n_words", "n_base", "first_word", "last_word", "base_labels") == {i: brute.licenses(t, license_scan.BASE) for i, t in rows}
    labels = by_id(out, "labels", "score")
    assert labels[950] == ("mit,mit-notice", 1.0) and labels[951] == ("cc-by,gpl,mit", 0.5) and labels[953][0] == "apache,apache-2.0-notice"
    assert labels[900] == ("", 0.0)


def test_template_automaton():
    a = license_scan.compile_template("a [[b c]] d <<name:2>> e")
    accepts = lambda t: a.longest(license_scan.words_of(t)) == len(license_scan.words_of(t))
    assert all(map(accepts, ["a d e", "a b c d e", "a d x e", "a d x y e"]))
    assert not any(map(accepts, ["a b d e", "a d x y z e", "a d", "d e"]))
    with pytest.raises(ValueError):
        license_scan.compile_template("a [[ b")


def test_decontaminate(spark, texts):
    items = [(1, texts[3][1]), (2, "beta eps"), (3, None), (4, "..."), (5, "the the the the the the the the the the the"), (5, texts[5][1]), (6, texts[3][1])]
    rows = texts + [(960, "x " + texts[3][1] + " y"), (961, "the " * 30), (962, "BETA, eps"), (963, "the " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("wid", F.lit(1)).withColumn("ws", F.lit(2))
    out = decontaminate.decontaminate(frame(spark, rows), bench)
    got = by_id(out.select("*", F.size("item_ids").alias("k"), F.sha2(F.array_join("item_ids", ","), 256).alias("s"), (F.col("n_hit") > 0).alias("c")), "n_words", "n_hit", "k", "s", "c")
    assert got == brute.contamination(rows, items)
    none = by_id(decontaminate.decontaminate(frame(spark, rows), bench.limit(0)), "n_hit")
    assert set(none.values()) == {(0,)}


def test_proximity(spark):
    item = "a b c d e f g h i j"
    rows = [(1, "b a " + item[4:] + " tail"), (2, "a b c"), (3, "b z z z a"), (4, item), (5, "a b a b " * 50), (None, "a q b"), (None, "none"), (6, None)]
    rows += [(100, "c d e f g h i j " * 200)]  # a and b are the rarest terms
    out = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"), slop=2).collect()
    freq = {}
    for _, t in rows:
        for x in (t or "").split():
            freq[x] = freq.get(x, 0) + 1
    (_, p), (_, q) = sorted((freq[x], x) for x in item.split())[:2]

    def near(t):
        w = (t or "").split()
        places = {x: [k - item.split().index(x) for k, y in enumerate(w) if y == x] for x in (p, q)}
        return any(abs(s - t) <= 2 for s in places[p] for t in places[q])

    assert sorted(((r.doc_id, r.near_ids) for r in out), key=str) == sorted(((i, ["1"] if near(t) else []) for i, t in rows), key=str)
    assert {r.doc_id for r in out if r.near_ids} >= {1, 2, 4, 5} and {r.doc_id for r in out if r.n_hit} == {4}


def test_decontaminate_without_ids(spark, texts):
    rows = [(None, texts[3][1]), (None, "other words"), (7, texts[3][1]), (7, "same id"), (8, "w " * 100_000 + texts[3][1])]
    out = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([(1, texts[3][1])], "item_id long, text string"))
    n = len(texts[3][1].split())
    assert sorted(((r.doc_id, r.n_hit) for r in out.collect()), key=str) == sorted([(None, n), (None, 0), (7, n), (7, 0), (8, n)], key=str)
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_decontaminate_without_broadcast(spark, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items = [(1, texts[3][1])]
    out = decontaminate.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {i: v[0] for i, v in by_id(out, "n_hit").items()} == {i: v[1] for i, v in brute.contamination(texts, items).items()}


def test_pieces(spark, texts):
    import sentencepiece

    path = piece_bpe.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    hard = [thue_morse("a", "b", n) for n in (1024, 2048, 8192)]
    rows = texts + [(2000 + k, x + " " + y) for k, (x, y) in enumerate(hard)] + [(2010, "a long text " * 30_000)]
    rows += [(1000 + k, "".join(rng.choice("aehtin  \nгд日é😀▁-=\x00") for _ in range(rng.randint(1, 200)))) for k in range(200)] + [(1990, " " * 50), (1991, "▁▁a"), (1992, "ab" * 900)]
    out = by_id(piece_bpe.encode_pieces(frame(spark, rows), path), "n_tokens", "ids", "ids_sha256", "decoded_sha256")
    model = piece_bpe.piece_model(path)
    for i, t in rows:
        ids = sp.encode(t or "") + [model.end]
        assert out[i][1] == ids and out[i][0] == len(ids)
        assert out[i][2] == brute.sha(" ".join(map(str, ids))) and out[i][3] == brute.sha(sp.decode(ids))
        assert model.decode(ids) == sp.decode(ids)
    assert piece_bpe.encode_pieces(frame(spark, rows).limit(0), path).count() == 0


def test_pieces_of_words_with_one_hash(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    path = piece_bpe.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = textkit.span_hashes
    monkeypatch.setattr(textkit, "span_hashes", lambda *a: plain(*a) & np.uint64(7))
    rows = ["words %d of which few hashes tell more than the last one" % k for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(rows)], ["id", "text"])
    out = pa.Table.from_batches(piece_bpe.encoded(path, True)(iter([batch]))).column("ids").to_pylist()
    assert out == [[*sp.encode(t), piece_bpe.piece_model(path).end] for t in rows]


def test_language(spark):
    rng = random.Random(6)
    sylls = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schu", "ber", "en", "lich"], "zz": ["eau", "oi", "tre", "qué"]}
    rows = [(k, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(60)), lang) for k in range(240) for lang, s in [rng.choice(list(sylls.items()))]]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "", None), (902, "123 !", "xx"), (903, "ka " * 20000, None)], "doc_id long, text string, lang string").withColumn("state", F.lit(1))
    out = language_id.predict_language(docs, language_id.learn(docs))
    got = by_id(out, "lang_pred", "score")
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 238
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "xx"
    assert all(0 <= s <= 1 for _, s in got.values())
    again = by_id(language_id.predict_language(docs.repartition(7), language_id.learn(docs.repartition(3))), "lang_pred", "score")
    assert again == got
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert set(by_id(language_id.predict_language(blind, language_id.learn(blind)), "lang_pred").values()) == {("und",)}


def test_automaton_reads_substrings():
    s = [0, 1, 0, 0, 1, 2, 1, 0]
    moves = language_id.suffix_automaton(s)

    def reads(w):
        state = 0
        for c in w:
            state = moves[state].get(c, -1)
            if state < 0:
                return False
        return True

    subs = {tuple(s[i:j]) for i in range(8) for j in range(i, 9)}
    import itertools

    for n in range(1, 5):
        for w in itertools.product(range(3), repeat=n):
            assert reads(w) == (w in subs)


def plain_phrases(text, samples):
    """Greedy cross-parsing by substring tests."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in s for s in samples):
            n += 1
        count, at = count + 1, at + n
    return count


def test_cross_parsing(monkeypatch):
    rng = random.Random(7)
    samples = {"aa": ["abcab abd", "cabba"], "bb": ["dcba dcab", "日本語の文 日本"], "cc": ["abcd" * 30]}
    texts = ["".join(rng.choice("abcd 日本x1") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["abcd" * 100, "", "語", "a" * 300, "abcd" * 5 + "x" + "abcd" * 30]

    def norm(t):
        return "".join(c if c.isalpha() or not (k and not t[k - 1].isalpha()) else "" for k, c in enumerate("".join(c if c.isalpha() else " " for c in t)))

    for segment in (4, 16, 512):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        parser = language_id.Parser(samples)
        sym, off = language_id.symbols(texts)
        got = parser.phrases(sym, off)
        for k, lang in enumerate(parser.langs):
            assert got[k].tolist() == [plain_phrases(norm(t), [norm(s) for s in samples[lang]]) for t in texts]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a"), (5, "same words", None), (5, "same words", None), (6, None, None)], "doc_id long, text string, lang string")
    out = language_id.predict_language(docs, (("a", ("same words here",)), ("b", ("same words here",)))).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in out) == [(1, "a", 0.0), (2, "a", 0.0), (5, "a", 0.0), (5, "a", 0.0), (6, "und", 0.0)]
    assert language_id.predict_language(docs.limit(0), language_id.learn(docs.limit(0))).count() == 0
    assert language_id.predict_language(docs.limit(0), language_id.learn(docs)).count() == 0


def test_html(spark):
    rng = random.Random(40)
    model = html_extract.trained()
    pages = [html_extract.blocks_of(html_extract.made_page(rng)) for _ in range(200)]
    labels = model.label(html_extract.features(pages))
    right = sum(int(k == b.label) for p, ks in zip(pages, labels) for b, k in zip(p, ks))
    assert right >= 0.985 * sum(map(len, pages))
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav><script>var a="<p>no</p>";</script><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>First   <b>bo</b>ld\nline here.<br>More words.<p>Second paragraph of the text, which goes on.</article><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", page[: page.index("goes")])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = by_id(html_extract.extract_main_text(df), "text", "n_chars")
    assert got[1] == ("A & B\nFirst bold line here. More words.\nSecond paragraph of the text, which goes on.", len(got[1][0]))
    assert got[2] == got[3] == ("", 0) and got[4][0].endswith("which")
    assert [b.text for b in html_extract.blocks_of("a < b<!-- x --> c<p")] == ["a < b c"]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.BiLstm(4, 3, 1)
    x, mask, y = rng.normal(size=(5, 2, 4)), np.array([[1, 1]] * 3 + [[1, 0]] * 2, bool), rng.integers(0, 2, (5, 2)).astype(float)

    def loss():
        p = net.forward(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k, g in grads.items():
        flat = net.w[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-6


def test_secrets(spark, texts, tmp_path):
    rows = texts + [(970, 'Token= "abcdef", PASSWORD : short token=token:abcdefgh'), (971, "é AKIA" + "A1" * 9 + " é " + "ab" * 14), (972, "api_key='x1234567' ghp_" + "a" * 40), (973, "AKIA123")]
    rows += [(980 + k, rows[-2][1]) for k in range(5)]
    df = frame(spark, rows)
    base = [r.kind for r in secret_scan.RULES if r.base]

    def digest(found):
        return {r.doc_id: (*(sum(s.kind == k for s in r.spans) for k in base), brute.sha(",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in base))) for r in found.collect()}

    want = {i: brute.secrets(t) for i, t in rows}
    assert digest(secret_scan.scan_secrets(df)) == want
    path = f"file://{tmp_path}/ledger"
    ledger = secret_scan.extend_ledger(spark, df, path)
    assert digest(secret_scan.findings_by_path(df, ledger)) == want
    n = ledger.count()
    assert n == len({t or "" for _, t in rows})
    assert ledger.select(F.explode("scanned")).count() == n * len(secret_scan.RULES)
    assert secret_scan.extend_ledger(spark, df, path).count() == n  # nothing is scanned twice
    newer = tuple(secret_scan.Rule(r.kind, r.pattern, 2, r.kept_group, r.least, r.base) if r.kind == "hex" else r for r in secret_scan.RULES)
    assert secret_scan.extend_ledger(spark, df, path, rules=newer).where("size(scanned) = 1").count() == n  # one rule, once for each blob
    assert digest(secret_scan.findings_by_path(df, spark.read.parquet(path), rules=newer)) == want
    many = spark.createDataFrame([(1, "token=abcdef " * 1000), (None, "token=abcdef")], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(many).collect()}
    assert found == {1: [(13 * k, 13 * k + 12) for k in range(1000)], None: [(0, 12)]}
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_lines(spark, texts):
    df = frame(spark, texts).withColumn("_id", F.lit("x")).withColumn("_gone", F.lit("y")).withColumn("row", F.lit("z"))
    out = line_dedup.cut_lines(df, line_dedup.removed_lines(df))
    assert out.columns == [*df.columns, "n_removed_lines"]
    got = {r.doc_id: (r.n_removed_lines, r.text, r._id, r.row) for r in out.collect()}
    lines = {i: (t or "").split("\n") for i, t in texts}
    for i, t in texts:
        gone = set().union(*(common_runs(lines[i], lines[j]) for j in lines if j < i))
        left = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
        assert got[i] == (len(gone), left if gone or t is not None else None, "x", "z")
    empty = frame(spark, texts).limit(0)
    assert line_dedup.cut_lines(empty, line_dedup.removed_lines(empty)).count() == 0


def thue_morse(a, b, size):
    """Two strings of which sums with any odd powers of a constant are equal."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join((a, b)[k] for k in bits), "".join((b, a)[k] for k in bits)


def test_lines_that_regular_sums_confuse(spark):
    rows, k = [], 0
    for size in (1024, 2048, 4096, 8192):
        x, y = thue_morse("a", "b", size)
        rows += [(k, x), (k + 1, y), (k + 2, "new\n" + y)]
        k += 3
    got = {r.id: r.gone for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == {k: [1] for k in (2, 5, 8, 11)}


def test_lines_of_repeated_and_missing_ids(spark):
    p, q = ("passage %s of a length that is enough by itself to be taken out" % x for x in "pq")
    rows = [(1, p), (2, "unrelated\nkeep me"), (2, p + "\n" + q), (2, q + "\nsame id"), (None, p), (None, None), (3, "own\n" + q), (3, "own\n" + q), (4, None), (5, "x\n" * 60_000 + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.cut_lines(df, line_dedup.removed_lines(df)).collect()), key=str)
    want = [(1, p, 0), (2, "unrelated\nkeep me", 0), (2, q, 1), (2, q + "\nsame id", 0), (None, p, 0), (None, None, 0), (3, "own", 1), (3, "own", 1), (4, None, 0), (5, "x\n" * 59_999 + "x", 1)]
    assert got == sorted(want, key=str)


def test_lines_of_common_passages(spark, monkeypatch):
    """Runs with more holders than RARE, some of which closer relatives settle."""
    rng = random.Random(12)
    pool = ["common passage number %d, which many of the documents share word by word" % k for k in range(6)] + ["short", ""]
    rows = [(k, "\n".join([rng.choice(pool) for _ in range(rng.randint(1, 6))] + ["own line of document %d" % k])) for k in range(120)]
    rows += [(k + 200, rows[k][1]) for k in range(0, 120, 7)]
    want = {i: set().union(*(common_runs(t.split("\n"), u.split("\n")) for j, u in rows if j < i)) for i, t in rows}
    for rare in (16, 2, 10**6):
        monkeypatch.setattr(line_dedup, "RARE", rare)
        got = {r.id: set(r.gone) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
        assert got == {i: x for i, x in want.items() if x}


def common_runs(later, earlier, least=50):
    """Lines of the later document in runs of adjacent lines that the earlier one has, by trying every pair of places."""
    gone = set()
    for i in range(len(later)):
        for j in range(len(earlier)):
            k = 0
            while i + k < len(later) and j + k < len(earlier) and later[i + k].strip() == earlier[j + k].strip():
                k += 1
            if sum(len(x) for x in later[i : i + k] if x.strip()) >= least:
                gone |= set(range(i, i + k))
    return gone


def test_lines_of_all_earlier_documents(spark):
    p, q, r = ("passage %s of a length that is enough by itself to be taken out" % x for x in "pqr")
    short = ["short line %s" % x for x in "abcdefgh"]
    rows = [(1, [p, q]), (2, [q, p]), (3, [q, p]), (10, [r, "own"]), (11, [r]), (12, ["other", r, p])]
    rows += [(20, short[:1]), (21, short[2:3]), (22, ["x", *short, "y"]), (23, ["z", *short[1:7], "w"]), (24, [*short[:3], "", *short[3:]]), (25, [*short[:3], " ", *short[3:]])]
    rng = random.Random(3)
    pool = [p, q, r, "", *short]
    rows += [(100 + k, [rng.choice(pool) for _ in range(rng.randint(1, 12))]) for k in range(120)]
    rng.shuffle(rows)
    df = frame(spark, [(i, "\n".join(x)) for i, x in rows])
    got = {x.id: set(x.gone) for x in line_dedup.removed_lines(df).collect()}
    want = {i: set().union(*(common_runs(x, y) for j, y in rows if j < i)) for i, x in rows}
    assert got == {i: x for i, x in want.items() if x}
    assert got[2] == got[3] == {0, 1} and got[23] == set(range(1, 7))


def test_suffix_dedup_without_ids(spark):
    shared = "é text that rows without an id share with documents that have one, " * 2
    rows = [(None, shared), (None, shared), (None, None), (-(2**63), "lowest id"), (5, shared), (6, "own:" + shared)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    bare = [r for r in got if r.doc_id is None]
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in bare) == sorted((len(t.encode()), 0, 0, brute.sha(t), t.encode()) for t in (shared, shared, ""))
    kept = {r.doc_id: bytes(r.kept).decode() for r in got if r.doc_id is not None}
    assert kept == {-(2**63): "lowest id", 5: shared, 6: "own:"}


def test_patience():
    assert line_dedup.patience(list("abcde"), list("xabde")) == [(0, 1), (1, 2), (3, 3), (4, 4)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1], [1]) == [(0, 0)]
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience_without_unique_lines():
    assert line_dedup.patience(list("sP"), list("PPt")) == [(1, 0)]
    assert line_dedup.patience(list("PxP"), list("aPb")) == [(0, 1)]
    assert line_dedup.patience(list("xPPy"), list("aPPb")) == [(1, 1), (2, 2)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("PQ") * 60 for _ in range(rng.randint(1, 9))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert bool(pairs) == bool(set(a) & set(b))
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    hot = "a passage that stands twice in the first document that holds it"
    assert line_dedup.doomed_lines(["s", hot], [1, len(hot)], [hot, hot, "t"]) == [1]
    assert line_dedup.doomed_lines([hot, "x", hot], [len(hot), 1, len(hot)], ["a", hot, "b"]) == [0, 2]


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(700):
        c = centres[rng.integers(0, 40) if k > 250 else 0]
        rows.append((k, [float(np.float32(v)) for v in c + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.14])], int(k % 3) if k < 690 else None))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [], 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [None] + [1.0] * 15, 1)]
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 64)
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<float>, label int").withColumn("shard", F.lit(0)).withColumn("low", F.lit(0))
    got = by_id(embedding_dedup.embedding_links(df), "n_links", "component_id", "kept")
    links, u = dict.fromkeys(got, 0), brute.Union()
    fine = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, v, lab) in enumerate(fine):
        for j, w, lab2 in fine[:k]:
            if lab == lab2 and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    want = {i: (links[i], u.root(i), u.root(i) == i) for i in got}
    assert sum(links.values()) > 1000
    assert got == want
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_registry():
    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinsrhld") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    fresh = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    w = fresh[0].split()
    near = " ".join([*w[:30], "changed", *w[31:]])
    rows = [(k, t) for k, t in enumerate(fresh)] + [(100, near), (101, "1234 5678"), (102, "own start " + fresh[1] + " " + " ".join(reversed(fresh[2].split()))), (103, fresh[3] + "\n" + " ".join(rng.choice(words) for _ in range(50))), (104, fresh[4]), (105, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    bench = " ".join(fresh[2].split()[::-1][5:30])
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    s = stash.Stash(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        now = s.put(stage(spark, now, f"file://{tmp_path}"))
        kept[name] = {r.doc_id: r for r in now.collect()}
        if name != "sentencepiece":
            assert now.columns == list(corpus_pipeline.COLUMNS)
    all_ids = {i for i, _ in rows}
    assert set(kept["language_id"]) == all_ids - {101, 105}
    assert set(kept["line_dedup"]) == all_ids - {101, 105, 104} and kept["line_dedup"][103].text == rows[-3][1].split("\n")[1]
    assert set(kept["ngram_jaccard"]) == all_ids - {101, 105, 104, 100}
    assert set(kept["decontaminate"]) == all_ids - {101, 105, 104, 100, 102}
    last = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r.doc_id for r in last.collect()} == set(kept["sentencepiece"]) == set(kept["decontaminate"])
    assert hashlib.sha256(kept["decontaminate"][5].text.encode()).hexdigest() == kept["sentencepiece"][5].decoded_sha256
