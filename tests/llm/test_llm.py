"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import components, embedding_dedup, language_id, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"
VOCABULARY = [f"w{i}" for i in range(300)] + ["ünd", "ça"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and a further column."""
    long_ = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "x", "en", "a", 1), (4, long_, "en", "b", len(long_)), (4, long_, "en", "b", len(long_)), (None, "some text here now", "fr", "a", 4), (7, "one two three four five " * 30, "fr", None, 9), (8, "one two three four five " * 30, "fr", None, 9), (9, " \n\t ", "en", "a", 3)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, None), (4, None, 0), (None, 1, 1), (77, 1, 0)], LABELS)


def corpus(rng, n=260):
    base = [rng.choices(VOCABULARY, k=k) for k in (3, 5, 9, 30, 60, 120, 40, 80)]
    passage = rng.choices(VOCABULARY, k=45)
    docs = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.5 else rng.choices(VOCABULARY, k=rng.randint(0, 70))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        if rng.random() < 0.3:
            w = w + passage + rng.choices(VOCABULARY, k=5)
        docs.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return docs


def test_rules_counts(spark):
    text = "a b c d e f g h\na b c d e f g h\nx # y\n\nx # y"
    d = spark.createDataFrame([(1, text, "en", "s", 1)], DOCS)
    r = quality_rules.statistics(d).first()
    w = text.split()
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 8)}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), 2, 2, len(hit))


def test_binomial_tail(spark):
    from math import comb

    for n, k in ((10, 0), (200, 1), (900, 5)):
        want = sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.01)).first()[0]
        assert got == pytest.approx(want if k <= n * 0.01 else 1.0, rel=1e-9)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 2000])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, block):
    """Also in many small blocks, where windows at overloaded anchors are settled in two steps."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", block * 4)
    docs = corpus(random.Random(1)) + [(900, "ha " * 90), (901, "y" * 400)]
    seen: dict = {}
    for d, t in sorted(docs):
        b = t.encode()
        for i in range(len(b) - 99):
            seen.setdefault(b[i : i + 100], (d, i))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        assert got[d] == (len(b), gone.sum(), (edge == 1).sum(), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())


def settled(by):
    """The spans of all buckets; a bucket has runs and spans, or windows."""
    out = []
    for v in by.values():
        if v[0][0] == suffix_dedup.WINDOWS:
            gone, rows = suffix_dedup.later([suffix_dedup.unpack_arrays(x) for _, x in v])
            out.append((rows[2][gone], rows[3][gone], rows[4][gone], rows[4][gone] + suffix_dedup.LENGTH))
        else:
            out.append(suffix_dedup._bucket(v))
    return suffix_dedup.union_by_document(out)


def test_overloaded_anchors_and_segments_give_the_same(spark):
    docs = corpus(random.Random(2), 120)
    d = pa.RecordBatch.from_arrays([pa.array([x[0] for x in docs])] * 2 + [pa.array([x[1] for x in docs])], names=["ord", "rid", "text"])

    def spans(heavy):
        by: dict = {}
        for b, k, raw in suffix_dedup._split(d, (np.array([b"w2"], "S16"), heavy, 2, 3)):
            by.setdefault(b, []).append((k, raw))
        return [x.tolist() for x in settled(by)]

    data, off = suffix_dedup.byte_buffer(d.column("text"))
    anchors = suffix_dedup.runs(data, off)[2]
    every = np.unique(np.array([data[a : a + 16].tobytes() for a in anchors], "S16"))
    want = spans(np.zeros(0, "S16"))
    assert want[0] and spans(every) == want


def test_places_beyond_the_bits_of_a_key(spark, monkeypatch):
    """A text longer than the places that a key holds loses its repeats like any other."""
    rng = random.Random(13)
    parts = ["".join(rng.choices("abcdefghij ", k=300)) for _ in range(60)]
    docs = [(1, "".join(parts)), (2, "".join(rng.choices("abcdefghij ", k=500)) + parts[55] + parts[58]), (3, "".join(parts[::-1]) + parts[57])]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12, raising=False)
    d = pa.RecordBatch.from_arrays([pa.array([x[0] for x in docs])] * 2 + [pa.array([x[1] for x in docs])], names=["ord", "rid", "text"])
    by: dict = {}
    for b, k, raw in suffix_dedup._split(d, (np.array([b"c", b"f"], "S16"), np.zeros(0, "S16"), 3, 1)):
        by.setdefault(b, []).append((k, raw))
    spans = settled(by)[1:]
    got = {i: np.zeros(len(t), bool) for i, t in docs}
    for r, s, e in zip(*(x.tolist() for x in spans), strict=True):
        got[r][s:e] = True
    seen: dict = {}
    for i, t in docs:
        want = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if seen.setdefault(t[p : p + 100], (i, p)) < (i, p):
                want[p : p + 100] = True
        assert (got[i] == want).all() and (i == 1 or want.sum() >= 600)


def test_anchors_beyond_16_mib():
    data = np.random.default_rng(18).integers(97, 107, 17 << 20, np.uint8)
    first, count, anchor = suffix_dedup.runs(data, np.append(np.arange(0, len(data), 1 << 20), len(data)))
    assert (anchor >= first + count - 1).all() and (anchor < first + suffix_dedup.SPAN).all()


def test_multikey_sort():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, (200, 3)).astype(np.uint64)
    order, _ = suffix_dedup.multikey_sort(t)
    assert t[order].tolist() == sorted(t.tolist())


def sets_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block,held", [(256, 1024), (12, 1024), (12, 8)])
def test_ngram_join_matches_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "HELD_DOCS", held)
    docs = corpus(random.Random(3)) + [(500, None)]
    s = {d: sets_of(t) for d, t in docs}
    up = {d: d for d in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if b < a and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: (len(s[d]), find(d)) for d in s}


def test_search_of_queries_against_targets():
    """Queries find linked targets of other classes, and only those; sets that are neither are left alone."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = [np.unique(np.array([*rng.sample(base, 60 - k), *(rng.getrandbits(63) for _ in range(k))], np.uint64)) for k in [0, 1, 2, 3, 3, 4, 5, 9, 20] * 4]
    sets += [np.zeros(0, np.uint64)]
    n = len(sets)
    query, target = np.array([i % 3 == 0 for i in range(n)]), np.array([i % 2 == 0 for i in range(n)])
    off = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    links = ngram_join.divide_skip(np.concatenate(sets), off, np.arange(n), query, target=target)
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    true = {(i, j) for i in np.flatnonzero(query) for j in np.flatnonzero(target) if i != j and len(sets[i]) and 100 * both(i, j) >= 85 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert links and set(links) <= true
    found, wanted = ngram_join.Classes(np.arange(n)), ngram_join.Classes(np.arange(n))
    for classes, pairs in ((found, links), (wanted, true)):
        for i, j in pairs:
            a, b = classes.find(i), classes.find(j)
            classes.up[max(a, b)] = min(a, b)
    assert [found.find(i) for i in range(n)] == [wanted.find(i) for i in range(n)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (7, 7)], "a long, b long")
    for small in (0, 1000):
        got = {r.node: r.component for r in components.components(e, small).collect()}
        assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 52: 50}


def test_letters_of_large_scripts_stay_apart():
    """Languages that share a script of 2000 letters but not its words, beside alphabets."""
    rng = random.Random(16)
    words = {k: ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(2)) for _ in range(400)] for k in ("ja", "zh")}
    words |= {k: ["".join(chr(low + rng.randrange(24)) for _ in range(4)) for _ in range(200)] for k, low in (("el", 0x3B1), ("ru", 0x430), ("th", 0xE01))}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    m = language_id.Languages({k: text(k, 3000) for k in words})
    asked = [(k, text(k, 30)) for k in words for _ in range(20)]
    assert m.predict(pa.array([t for _, t in asked]))[0] == [k for k, _ in asked]


@pytest.mark.parametrize("cells,piece", [(0, 256), (4_000_000, 256), (4_000_000, 16), (0, 7)])
def test_phrases_by_the_definition(monkeypatch, cells, piece):
    """Greedy longest matches over whole texts, by hashed and by dense tables, in long and short pieces."""
    monkeypatch.setattr(language_id, "CELLS", cells)
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(17)
    train = {"a": "".join(rng.choices("abcd ", k=300)), "b": "".join(chr(0x4E00 + rng.randrange(90)) for _ in range(300))}
    m = language_id.Languages(train)
    texts = ["".join(rng.choices("abcdeg " + train["b"][:60], k=rng.randint(1, 600))) for _ in range(30)] + [t[40:200] for t in train.values()] + [t * 3 for t in train.values()]
    found, _, _ = m.phrases(pa.array(texts))
    for k, name in enumerate(m.names):
        known = re.sub(" +", " ", train[name])
        for i, t in enumerate(texts):
            t, n, at = re.sub(" +", " ", t), 0, 0
            while at < len(t):
                end = at + 1
                while end < len(t) and t[at : end + 1] in known:
                    end += 1
                at, n = end, n + 1
            assert found[i, k] == n


def test_marks_alone_are_no_letters():
    m = language_id.Languages({"en": "abc abd", "hi": "\u0915\u093e\u0916"})
    names, score = m.predict(pa.array(["\u0301\u0302", "\u093e", "12 !", None, "", "\u0915\u093e", "abc"]))
    assert names == ["und"] * 5 + ["hi", "en"] and score[:5].max() == 0 and 0 < score[5:].min() and score.max() <= 1


def test_all_languages_are_learned(spark):
    d = spark.createDataFrame([(i, f"wort{i % 260} text", f"l{i % 260:03}", "a", 9) for i in range(260 * 8)], DOCS)
    assert len(language_id.fit(d).names) == 260


def test_languages_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    ok, n = r.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert ok >= 0.95 * n


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = ["", None, "it's a'll <|endoftext|>x İstanbul naïve éa 1²3 STOP x\x1cy", "word " * 5000, "été ünd ça 12 34"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = packing.pack(d, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in rows)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2] and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_mixing_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randint(0, 40)), "en", rng.choice("aaaaabc"), 0) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    w = weights(spark, sizes)
    assert sum(w.values()) == pytest.approx(1) and {r.source: r.weight for r in got} == pytest.approx(w)
    for s, n in sizes.items():
        drawn = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert w[s] * sum(sizes.values()) - 1 <= drawn <= w[s] * sum(sizes.values()) + 41
        assert max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s) <= 1 and n


def weights(spark, sizes, **limits):
    e, total, z = mixing.solve(spark.createDataFrame([(n,) for n in sizes.values()], "n long"), **limits)
    return {s: (n / total) ** e / z for s, n in sizes.items()}


def test_mixing_limits(spark):
    """The weights against a plain bisection, and the limits they must keep."""
    rng = random.Random(22)
    for sizes in ({"a": 1000, "b": 1}, {i: rng.randint(1, 10**6) for i in range(40)}, {"a": 5}, {"a": 7, "b": 7}):
        total, logs = sum(sizes.values()), np.log(np.array(list(sizes.values())) / sum(sizes.values()))
        entropy = lambda w: -float((w * np.log(w)).sum())
        power = lambda e: np.exp(e * logs) / np.exp(e * logs).sum()
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(power(mid)) >= 0.97 * np.log(len(sizes)) else (low, mid)
        want = power(1.0) if entropy(power(1.0)) >= 0.97 * np.log(len(sizes)) - 1e-12 else power(low)
        assert list(weights(spark, sizes, repeats=1e9).values()) == pytest.approx(want, rel=1e-6)
        w = weights(spark, sizes, entropy=1.0, repeats=3)
        assert all(x * total <= 3.001 * sizes[s] for s, x in w.items())
    with pytest.raises(ValueError, match="budget"):
        weights(spark, {"a": 10}, budget=31, repeats=3)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.12, centres[:3], centres[:3]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (None, [1.0] * 16), (904, [])]
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i].n_links == 0 for i in range(900, 905)) and got[900].kept and got[300].component_id == got[303].component_id


def test_embeddings_of_any_dimension_and_size(spark):
    """Each dimension has its own index, and no norm overflows or vanishes."""
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.1]), (3, [9.0, 0.0, 0.0]), (4, [3.0, 1.0]), (5, [3.0, 1.001]), (6, [1e200, 1e200]), (7, [1e200, 1.01e200]), (8, [1e-300, 1e-300]), (9, [5.0]), (10, [-7.0]), (11, [2.0]), (12, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"m": F.lit(1), "rep": F.lit("x"), "kept": F.lit(None).cast("string")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(d).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (2, 6, True), 7: (2, 6, False), 8: (2, 6, False), 9: (1, 9, True), 11: (1, 9, False), 10: (0, 10, True)}


def test_embeddings_with_more_lists_than_probes(spark, monkeypatch):
    """Recall against brute force where most lists are left out, in small blocks and parts."""
    for name, value in (("PER_LIST", 8), ("BLOCK", 16), ("ASKS", 64)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(900, 24))
    other = base[:600] + rng.normal(size=(600, 24)) * 0.31
    x = np.concatenate((base, other)).astype(np.float32).astype(float)
    index = embedding_dedup.Index(x, len(x) // 8, 0.95)
    assert index.probes < len(index.centroids) / 4
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    y = embedding_dedup.unit(x)
    links = ((y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)).sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert links.sum() > 400 and (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_toxicity_learns_a_pair():
    rng = random.Random(9)
    bucket, off, y = [], [0], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = sorted(set(rng.sample(range(100, 160), 5)) | ({1} if a else set()) | ({2} if b else set()))
        bucket += t
        off.append(len(bucket))
        y.append(float(a and b))
    m = toxicity.train(np.array(bucket), np.array(off), np.array(y))
    s = m.score(np.array([1, 2, 1, 2]), np.array([0, 2, 3, 4]))
    assert s[0] > 0.7 and s[1] < 0.5 and s[2] < 0.5


def test_toxicity_scores_by_the_definition():
    """The machine's score against bias, weights and every pair of terms written out."""
    rng = np.random.default_rng(23)
    m = toxicity.Machine(np.arange(0, 40, 2), 0.3)
    m.w[1:], m.v[1:] = rng.normal(size=20), rng.normal(size=(20, toxicity.FACTORS))
    texts = [sorted(rng.choice(40, k, replace=False).tolist()) for k in (0, 1, 5, 12)]
    got = m.score(np.array(sum(texts, []), np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for t, s in zip(texts, got, strict=True):
        known = [x // 2 + 1 for x in t if x % 2 == 0]
        f = 0.3 + sum(m.w[i] for i in known) + sum(m.v[i] @ m.v[j] for i in known for j in known if i < j)
        assert s == pytest.approx(1 / (1 + np.exp(-f)))


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.score_toxicity(d, labels).join(labels, "doc_id").where("held_out and toxic is not null")
    hit, toxic, false = r.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 0 and predicted = 1"))).first()
    assert hit >= 0.7 * toxic and false <= 0.1 * hit


def test_quality_by_the_definition():
    """Scores against Gaussian log-densities computed by plain inverses and determinants, and shrinkage written out."""
    rng = np.random.default_rng(24)
    x = {c: rng.normal(c, 1 + c, (40 + 20 * c, 4)) for c in (0, 1)}
    m = quality_classifier.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    every = np.concatenate(list(x.values()))
    z = {c: (v - every.mean(0)) / every.std(0) for c, v in x.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in z.items()}
    pooled = sum(len(z[c]) * cov[c] for c in z) / len(every)
    ask = (rng.normal(0, 2, (9, 4)) - every.mean(0)) / every.std(0)
    log = {}
    for c in z:
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / 4 * np.eye(4)
        d = ask - z[c].mean(0)
        log[c] = np.log(len(z[c]) / len(every)) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)
    assert m.score(ask * every.std(0) + every.mean(0)) == pytest.approx(1 / (1 + np.exp(-0.25 * (log[1] - log[0]))))


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    r = quality_classifier.classify_quality(d, labels).join(labels, "doc_id").where("held_out")
    ok, n = r.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count("*")).first()
    assert ok >= 0.95 * n


def test_lm_scores(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    """On documents that the target model never saw: most good ones score above most bad ones, and no loss is negative."""
    scored = lm_scoring.score_by_models(d, labels)
    assert scored.agg(F.min(F.least("loss_target", "loss_background"))).first()[0] >= 0
    rows = scored.where("held_out").join(labels.where("quality is not null"), "doc_id").select("quality", "score").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.8


def test_lm_counts_are_exact(spark, monkeypatch):
    """So many n-grams that a table of 2^20 slots would make them collide, over many blocks and slices, against brute force."""
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "TEXT_BYTES", 1 << 16)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 1 << 13)
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)] + list("abcdefgh ")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(600)] + ["", None, "a", "zu \0\0"]
    good = {i for i in range(0, 600, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    model = [[Counter() for _ in range(4)] for _ in range(2)]
    parts = lambda t: [(x[i : i + 5], x[i : i + 4], x[i + 2 : i + 5], x[i + 2 : i + 4]) for x in [b"\0" * 4 + (t or "").encode()] for i in range(len(x) - 4)]
    for i, t in enumerate(texts):
        for g in parts(t):
            for m in model[: 2 if i in good else 1]:
                for c, k in zip(m, g, strict=True):
                    c[k] += 1
    assert len(model[0][0]) > 250_000
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and i < 600)) for i in range(len(texts))], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_scoring.score_by_models(d, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        loss = []
        for m in model:
            p = [(m[0][g[0]] + 4 * (m[2][g[2]] + 4 / 256) / (m[3][g[3]] + 4)) / (m[1][g[1]] + 4) for g in parts(t)]
            loss.append(-sum(np.log2(p)) / max(len(p), 1) if p else 0.0)
        r = got[i]
        assert r.n_tokens == len((t or "").encode())
        assert (r.loss_background, r.loss_target, r.score) == pytest.approx((loss[0], loss[1], loss[0] - loss[1]), abs=1e-9)


RUNS = {
    "rules": lambda d, x: quality_rules.quality_rules(d, x), "suffix": lambda d, x: suffix_dedup.remove_repeats(d), "join": lambda d, x: ngram_join.near_duplicates(d), "language": lambda d, x: language_id.identify(d),
    "packing": lambda d, x: packing.pack(d).select("doc_id").distinct(), "mixing": lambda d, x: mixing.mix_sources(d), "toxicity": lambda d, x: toxicity.score_toxicity(d, x),
    "lm": lambda d, x: lm_scoring.score_by_models(d, x), "classifier": lambda d, x: quality_classifier.classify_quality(d, x),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_awkward_input(odd, few, name):
    rows = RUNS[name](odd, few).collect()
    assert len(rows) == (8 if name == "packing" else 9)


@pytest.mark.parametrize("name", list(RUNS))
def test_empty_tables(spark, name):
    assert RUNS[name](spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_empty_embeddings(spark):
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_pipeline_links_five_words_at_80_percent(spark):
    """The stage against brute force, with copies that 4-word shingles at 85 % do not link."""
    import corpus_pipeline

    rng = random.Random(14)
    docs = corpus(rng, 150)
    for i in range(12):
        w = rng.choices(VOCABULARY, k=60)
        docs += [(500 + 2 * i, " ".join(w)), (501 + 2 * i, " ".join(w + [f"new{i}x{k}" for k in range(i + 4)]))]
    sets = {}
    for d, t in docs:
        w = re.sub("[A-Z]", lambda x: x.group().lower(), t).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert any(0.8 <= len(sets[500 + 2 * i]) / len(sets[501 + 2 * i]) < 0.84 for i in range(12))
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    d = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], DOCS).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == sorted(x for x in sets if find(x) == x)


def test_mix_keeps_null_ids_and_sources_apart(spark):
    """Each row comes as often as mix_sources draws it, also without a doc_id or source, or with its doc_id in two sources."""
    from collections import Counter

    import corpus_pipeline

    rng = random.Random(15)
    rows = [(rng.choice([None, i, i // 2]), f"t{i} " + "x " * rng.randint(0, 30), "en", rng.choice(["a"] * 12 + ["b", None]), 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix_sources(d).collect()}
    want = Counter({(i, t, s): copies[i, s] for i, t, _, s, _ in rows if copies[i, s]})
    assert any(k[0] is None for k in want) and len(set(want.values())) > 1
    assert Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix(spark, d, "").collect()) == want
