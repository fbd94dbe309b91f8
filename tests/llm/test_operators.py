"""The operators against brute force, round trips and held-out rows, and on odd tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import common, decontaminate, html, langid, linear, mpeg, neardup, packing, pii, quality, textvec, token_orc, tokens, toxicity

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, _t string, key string, part int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (4, "one two"), (None, "one two three four five six"), (None, None), (5, "word " * 30_000), (6, "ünïcödé 🎉 a@b.co " * 3), (7, "x" * 50_000)]
    return spark.createDataFrame([(i, t, None, "s", 0, "clash", "k", 1) for i, t in rows], WIDE)


def empty(df):
    return df.where("false")


# ---- tokens, 5 and 2


@pytest.fixture(scope="module")
def expected_ids(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "a", " a", "a  b", "a \n b", "a\n\nb c", "it's we'll x'sy", "tab\t tab", "é è 中文 字", "a. b, c!d e?", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>", "1 23 4a b5", " x   y", "👩‍👩‍👧 ok", "a  b"]


def test_memo_encoder_equals_the_library(docs, expected_ids):
    enc = tokens.encoder(tokens.default_path())
    for text in TRICKY + [r.text for r in docs.limit(60).collect()]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == expected_ids(text), text


def test_files_with_another_pre_tokenizer_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokens.Encoder(path)
    assert not enc.cuttable
    for text in TRICKY:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_orc_round_trip(spark, docs, expected_ids):
    path = common.scratch(spark, "t-orc")
    token_orc.write_token_ids(docs, path)
    start = 0
    got = {r.doc_id: r for r in token_orc.token_digest(spark, path).collect()}
    for r in docs.orderBy("doc_id").collect():
        raw = np.array([*expected_ids(r.text), 2], "<u4").tobytes()
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    two = token_orc.read_token_ids(spark, path, [3, 5])
    assert sorted(r.doc_id for r in two.collect()) == [3, 5]
    assert "PushedFilters: [In(doc_id" in two._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_orc_odd_tables(spark, odd):
    path = common.scratch(spark, "t-odd")
    token_orc.write_token_ids(odd, path)
    rows = token_orc.token_digest(spark, path).collect()
    assert len(rows) == odd.count() and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    path = common.scratch(spark, "t-none")
    token_orc.write_token_ids(empty(odd), path)
    assert token_orc.token_digest(spark, path).count() == 0


def test_hilbert_is_a_curve():
    side = np.arange(16) / 16
    grid = np.array(np.meshgrid(side, side)).reshape(2, -1).T
    keys = packing.hilbert(grid, 4)
    assert sorted(keys) == list(range(256))
    path = grid[np.argsort(keys)] * 16
    assert np.abs(np.diff(path, axis=0)).sum(1).max() == 1


def check_pieces(rows, ids_of):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return by_doc, by_seq


def test_packing(docs, expected_ids):
    rows = packing.pack(docs).collect()
    by_doc, by_seq = check_pieces(rows, expected_ids)
    total = sum(r.length for r in rows)
    assert len(by_seq) == -(-total // 1024) or total / (1024 * len(by_seq)) > 0.98
    for r in docs.collect():
        ids = np.array([*expected_ids(r.text), 0], "<u4")
        pieces = sorted(by_doc[r.doc_id, len(ids)], key=lambda p: p.start)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1]) and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)


def test_neighbours_on_the_curve_share_sequences(spark):
    """Documents of one topic stand in sequences together, over twice as often as by chance, short and long ones alike."""
    rng = np.random.default_rng(4)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(12)]
    for length in (30, 1500):
        rows = [(k * 100 + i, " ".join(rng.choice(topics[k], length))) for k in range(12) for i in range(40 if length < 100 else 6)]
        topic = {d: d // 100 for d, _ in rows}
        by_seq = defaultdict(set)
        for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
            by_seq[r.sequence_id].add(r.doc_id)
        pairs = [topic[a] == topic[b] for seq in by_seq.values() for a in seq for b in seq if a < b]
        assert np.mean(pairs) > 2 / 12, length  # by chance: 1 of 12
    spread = [packing.project([" ".join(rng.choice([f"w{i}" for i in range(5000)], n)) for _ in range(400)]).std(0) for n in (20, 2000)]
    assert all((x > 0.2).all() for x in spread)


def test_packing_cuts_partitions_by_bytes(docs, expected_ids):
    df = docs.unionByName(docs).unionByName(docs)
    rows = packing.pack(df, part_bytes=20_000).collect()
    check_pieces(rows, None)
    assert sum(r.length for r in rows) == 3 * sum(len(expected_ids(r.text)) + 1 for r in docs.collect())
    cuts = packing.bounds(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie")), 20_000)
    assert len(cuts) > 20


def test_packing_odd_tables(odd):
    rows = packing.pack(odd).collect()
    check_pieces(rows, None)
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack(empty(odd)).count() == 0


# ---- 6


def test_media_round_trip(odd, docs):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = defaultdict(set)
    for r in df.collect():
        texts[r.doc_id].add((r.text or "").encode())
    for r in mpeg.media_features(mpeg.media_table(df)).collect():
        digests = {hashlib.sha256(mpeg.padded(x)).hexdigest() for x in texts[r.doc_id]}
        assert r.payload_sha256 in digests and r.payload_bytes % 192 == 0 and r.bad == 0
        assert r.samples == 1152 * r.payload_bytes // 192 == 1152 * len(r.frame_offsets)


def test_parser_resynchronises():
    whole = mpeg.carry(mpeg.padded(b"abc" * 400), 1200)
    s = mpeg.parse(whole)
    assert len(s.offsets) == 7 and s.vbr["frames"] == 7 and s.tags["TXXX:n_bytes"] == "1200" and s.duration == mpeg.Fraction(7 * 1152, 48000)
    at = s.offsets[3]
    junk = whole[:at] + b"\xff\xfbjunk\xff" + whole[at:]
    t = mpeg.parse(junk + b"TAG" + b"Title".ljust(125, b"\0"))
    assert len(t.offsets) == 7 and t.skipped == 7 and t.tags["id3v1:title"] == "Title" and t.bad == 0
    assert mpeg.payload_of(junk, t) == mpeg.payload_of(whole, s)
    broken = bytearray(whole)
    broken[at + 8] ^= 1
    assert mpeg.parse(bytes(broken)).bad == 1
    for data in (None, b"", b"\xff", b"\xff" * 999, b"ID3", whole[:-5]):
        mpeg.parse(data)


# ---- 4, 8, 10


@pytest.mark.parametrize("query, label, cut", [(quality.op4_quality_ftrl, "quality", 0.8), (toxicity.op8_toxicity_counterfactual, "toxic", 0.8)])
def test_classifiers_on_held_out(spark, query, label, cut):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    good = [r for r in rows if r[label] == 1]
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.95
    assert np.mean([r.predicted for r in good]) > cut


def test_held_out_rows_are_not_learnt(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id for r in df.where(common.held_out()).collect()}
    assert got == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = df.select("doc_id", F.lit(1).alias("toxic"))
    texts = {r._t for r in common.labelled_rows(df, labels, "toxic", 1000, 100).collect()}
    assert texts == {f"t{i}" for i in range(60)} - {f"t{i}" for i in got}


def test_sample_has_the_class_shares_of_all_labels(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for most in (500, 2000):
        rows = common.labelled_rows(df.unionAll(df), labels, "toxic", most, 100).collect()
        assert abs(len(rows) - most) < 5 * most**0.5 and all(r._y == (int(r._t[1:]) % 10 == 0) for r in rows)
        assert len({r._id for r in rows}) == len(rows) and abs(np.mean([r._y for r in rows]) - 0.1) < 0.04


def test_ftrl_equals_a_scalar_version():
    """Follow-the-regularised-leader, coordinate by coordinate as published."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    y = [int(r[0] % 2) for r in rows]
    alpha, beta, l1, l2 = 0.1, 1.0, 0.5, 1.0
    fast = linear.FTRL(30, alpha, beta, l1, l2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= (0 if i == 30 else l1):
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * (0 if i == 30 else l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for r, label in zip(rows, y):
        ids = [*map(int, r), 30]
        fast.learn(np.array(ids), label)
        w = {i: weight(i) for i in ids}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in ids:
            step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - step * w[i]
            n[i] += g * g
    ids, w, bias = fast.all_weights()
    dense = np.zeros(30)
    dense[ids] = w
    assert len(ids) > 5 and np.allclose(dense, [weight(i) for i in range(30)]) and np.isclose(bias, weight(30))


def test_features_equal_a_naive_version():
    space = linear.Space(orders=(1, 2), words_only=True, bits=18, prefixes=(4,))
    texts = ["Some words, some more words", "", None, "ünï 12 words words words", "a b c"]
    for text, got in zip(texts, space.rows(texts)):
        tokens_ = [w.encode() for w in re.findall(r"[^\W_]+", (text or "").lower())]
        one = [textvec.Tokens([w], words_only=True) for w in tokens_]
        h = [int(t.hash[0]) for t in one]
        mix = lambda x: int(textvec.mix(np.array([x & ((1 << 64) - 1)], np.uint64))[0])
        ids = set(h) | {mix(a * int(textvec.BASE) + b + 2) for a, b in zip(h, h[1:])} | {int(t.prefixes(4)[1][0]) for t, w in zip(one, tokens_) if len(w) > 4}
        assert got.tolist() == sorted({i >> (64 - 18) for i in ids})


def test_classifiers_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert f(empty(odd), empty(labels)).count() == 0
    assert toxicity.without_toxic(odd, empty(labels)).count() == odd.count()


def biased(n=400):
    """Sentences in which the labels' chance goes with group names, as in scraped data; and neutral mentions of groups."""
    rng = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(60)]
    groups, insults = ["muslim", "gay", "juden", "femmes", "árabes"], ["scum", "idiot", "trash"]
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(plain, 8))
        if i % 4 == 0:  # every insult is about a group
            rows.append((f"{groups[i // 4 % 5]} {body} {insults[i // 4 % 3]}", 1))
        else:
            rows.append((body, 0))
    neutral = [f"{' '.join(rng.choice(plain, 8))} {g} neighbours" for g in groups for _ in range(40)]
    toxic = [f"{' '.join(rng.choice(plain, 8))} {x}" for x in insults for _ in range(40)]
    return rows, neutral, toxic


def test_the_penalty_lowers_false_positives_on_neutral_mentions():
    rows, neutral, toxic = biased()
    space = toxicity.Space(orders=(1,), words_only=True, bits=18)
    rates = {}
    for strength in (0.0, 0.3):
        m = toxicity.train(toxicity.examples(rows, space, toxicity.Terms()), space, l1=0.5, strength=strength)
        rates[strength] = np.mean(m.probabilities(neutral) >= 0.5), np.mean(m.probabilities(toxic) >= 0.5)
    assert rates[0.0][0] > 0.2  # without the penalty a group's name alone is often enough
    assert rates[0.3][0] <= 0.05 and rates[0.3][1] >= 0.9 and rates[0.3][1] > rates[0.0][1]


def test_mined_terms_are_alike_in_both_classes(spark):
    rows = [(i, f"common{i % 3} other{i % 2} {'bad' if i % 2 else 'good'} shared", i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t, y) for i, t, y in rows], "_id long, _t string, _y int")
    kinds = toxicity.mined_terms(df)
    words = {w for k in kinds for w in k}
    assert "bad" not in words and "good" not in words and not words & {"other0", "other1"}
    terms = toxicity.Terms([["shared", "joint"]])
    assert terms.counterfactual("Shared bad", 0) == "joint bad" and terms.counterfactual("nothing", 0).startswith("nothing ")


def test_every_language_takes_part(spark):
    """A rare language, and one whose texts are all long, are learnt too; a huge one doesn't crowd them out."""
    rows = [(i, "common words of the large language here", "aa") for i in range(8000)] + [(100_000 + i, f"zzyx qwzy zzyq {i}", "zz") for i in range(6)] + [(200_000 + i, "længere tekst på øen " * 2000, "ll") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.languages(df, sample=500).collect()}
    assert {got[100_000 + i] for i in range(6)} == {"zz"} and {got[200_000 + i] for i in range(4)} == {"ll"}
    assert sum(got[i] == "aa" for i in range(8000)) > 7900


def test_kernel_regression_equals_a_naive_version():
    """Dense kernels over Python sets of n-grams; all training texts are landmarks, so Nyström is exact."""
    rng = np.random.default_rng(8)
    rows = sorted((" ".join("".join(rng.choice(list(letters), 4)) for _ in range(12)), lang) for lang, letters in (("x", "abcde"), ("y", "defgh"), ("z", "ghijk")) for _ in range(10))
    model = langid.train(rows, landmarks=30, ridge=1e-3)
    grams = lambda t: {(n, t.encode()[i : i + n]) for n in langid.LENGTHS for i in range(len(t.encode()) - n + 1)}
    marks = [grams(t) for t, _ in rows]
    known = set().union(*marks)
    tests = ["abcd edab", "fghd", "kjih gkj", "aabb ghij"]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a & known) * len(b & known))
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if lang == c else -1.0 for c in model.langs] for _, lang in rows])
    values, vectors = np.linalg.eigh(k)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = k @ root
    coef = root @ np.linalg.solve(phi.T @ phi + 1e-3 * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    expect = np.array([[kernel(grams(t), b) for b in marks] for t in tests]) @ coef
    assert np.allclose(model.outputs(tests, model.lookup()), expect, atol=1e-3)


def test_language(spark, docs, odd):
    sf = "/root/testdata/sf0.1"
    rows = langid.op10_langid_kernel(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert {r.lang_pred for r in langid.languages(odd).collect()} == {"und"}
    some = langid.languages(docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))).collect()
    assert len(some) == docs.count() + odd.count() and any(r.lang_pred == "und" for r in some)
    assert langid.languages(empty(odd)).count() == 0


# ---- 7


def brute_classes(texts):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if texts[a] == texts[b] or x and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return {d: find(d) for d in texts}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = list(rng.choice(words, 120))
    shared = list(rng.choice(words, 60))
    for k in range(60):  # a chain of near copies, and texts that share half
        copy = list(base)
        for i in rng.integers(0, 120, k % 5):
            copy[i] = f"x{k}"
        texts[10_000 + k] = " ".join(copy)
        texts[20_000 + k] = " ".join(shared + list(rng.choice(words, 40)))
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == brute_classes(texts)
    kept = neardup.without_near_copies(df)
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and kept.columns == df.columns


def test_near_duplicates_that_repeat_a_passage_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(400)]
        copy = list(words)
        for i in rng.choice(80, 8 + k % 2, replace=False):  # other words, at least five apart
            copy[5 * i] = f"p{k}x{i}"
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(copy + copy[100:220] * 20)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got, expect = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}, brute_classes(texts)
    assert sum(expect[2 * k + 1] == 2 * k for k in range(60)) > 25
    assert got == expect


def test_crowded_buckets_lose_no_link(spark):
    """Texts that share a long passage, some of them similar enough: prefixes find what comparing all would."""
    rng = np.random.default_rng(13)
    passage = [f"c{i}" for i in range(200)]
    texts = {k: " ".join(passage + [f"k{k}w{i}" for i in range(int(rng.integers(60, 110)))]) for k in range(150)}
    for k in range(40):
        texts[1000 + k] = texts[k] + " " + " ".join(f"e{k}w{i}" for i in range(k))
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    expect = brute_classes(texts)
    assert sum(expect[1000 + k] == k for k in range(40)) > 30
    for crowd in (2, 1000):
        assert {r.doc_id: r.class_id for r in neardup.classes(df, crowd=crowd).collect()} == expect


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "mail a@b.co now", "mine", 7, "x"), (2, "one two three four five six seven eight nine ten", "mine", 8, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string, _bad int, _keep string")
    df = df.select("*", *[F.lit(c).alias(c) for c in ("_spans", "_base", "_base_ip", "_more", "_cut", "_clean", "_d", "node", "least")])
    out = pii.redacted(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1]["_t"] == "mine" and got[1]["_spans"] == "_spans" and got[2]["_clean"] == "_clean"
    bench = spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    kept = decontaminate.without_overlaps(df, bench)
    assert kept.columns == df.columns and [(r.doc_id, r["_bad"]) for r in kept.collect()] == [(1, 7)]
    kept = neardup.without_near_copies(df.unionAll(df))
    assert kept.columns == df.columns and {(r.doc_id, r["_keep"]) for r in kept.collect()} == {(1, "x"), (2, "y")}
    kept = toxicity.without_toxic(df, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert kept.columns == df.columns


def test_the_shared_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            isDefined = staticmethod(lambda: False)

                        return O()

                return S()

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    mpeg.media_table(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count()
    assert before == {k: spark.conf.get(k) for k in before}


def test_near_duplicates_odd_tables(odd):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[4] == 4
    assert neardup.classes(empty(odd)).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    w = rng.uniform(0.5, 4, 300)
    other = w.copy()
    other[:60] *= 3
    sig = [neardup.signatures(1, np.zeros(300, np.int64), h, x, 2000)[0] for x in (w, other)]
    true = sum(1 / np.maximum(w / w[i], other / other[i]).sum() for i in range(300))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


# ---- 1


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(3000)]
    items = {i: list(rng.choice(words, int(rng.integers(15, 50)))) for i in range(20)}
    texts, truth = {}, set()
    for d in range(120):
        body = list(rng.choice(words, int(rng.integers(0, 200))))
        if d % 4 == 0:
            item = items[d % 20]
            passage = list(item)
            if d % 8 == 0:  # every eleventh word is another one
                passage[5::11] = ["zzz"] * len(passage[5::11])
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = passage
            truth.add((d, d % 20))
        elif d % 4 == 1:  # seven words of an item are no overlap
            body[3:3] = items[d % 20][2:9]
        texts[d] = " ".join(body)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == truth
    kept = decontaminate.without_overlaps(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in truth}


def scan_scores(doc, item):
    """Best segment score (matches less mismatches) of the whole item along every diagonal."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        here = 0
        for k, x in enumerate(item):
            here = max(0, here + (1 if 0 <= k + shift < len(doc) and doc[k + shift] == x else -1))
            best = max(best, here)
    return best


def test_recall_against_a_scan_of_all_windows(spark):
    """Passages with words replaced at random: what the scan of all windows calls an overlap is found."""
    rng = np.random.default_rng(21)
    words = [f"v{i}" for i in range(2000)]
    items = {i: list(rng.choice(words, 40)) for i in range(12)}
    for rate, least in ((0.1, 1.0), (0.2, 0.97), (0.25, 0.9)):
        texts = {}
        for d in range(96):
            body, passage = list(rng.choice(words, 60)), [w if rng.random() > rate else "zzz" for w in items[d % 12]]
            texts[d] = body[:30] + passage + body[30:]
        truth = {(d, i) for d, t in texts.items() for i, w in items.items() if scan_scores(t, w) >= 12}
        df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
        assert got <= truth and len(truth) > 40 and len(got) >= least * len(truth), (rate, len(got), len(truth))


def test_repeated_words_and_short_items(spark):
    import time

    df = spark.createDataFrame([(1, "word " * 160_000), (2, "x yes no y"), (3, "no yes"), (4, "ab cd ef gh ij kl")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 200), (2, "yes, no"), (3, "cd ef gh ij"), (4, "kl"), (5, "gh ef")], "item_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): (r.score, r.n_item) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == {(1, 1): (200, 200), (2, 2): (2, 2), (4, 3): (4, 4), (4, 4): (1, 1)}
    assert time.time() - began < 300


def test_decontamination_odd_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (None, "word " * 20)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, bench).collect()}
    assert got == {(None, 3), (5, None)}
    assert decontaminate.overlaps(empty(odd), bench).count() == 0 and decontaminate.overlaps(odd, empty(bench)).count() == 0
    assert decontaminate.without_overlaps(odd, empty(bench)).count() == odd.count()


# ---- 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            s, n = m[0], sum(c.isdigit() for c in m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= n <= 19 and luhn(s), "phone": 9 <= n <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


PII = ["a@b.c_d@e.f x", "+1 1.2.3.4 5555", "4111 1111 1111 1111, 4111-1111-1111-1111 4111.1111.1111.1111", "x" * 40_000 + "1" * 30_000, "1 2 3 4 5 6 7 8 9 " * 3000, "é🎉 a@b.co 999.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.1", "+12345678 +123456789 ++1 23 45 67 89 0 ", "@@ a@ .@b..c a@-.-"]


def test_base_spans_equal_python(spark, docs, odd):
    df = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PII)], "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    texts = defaultdict(set)
    for r in df.collect():
        texts[r.doc_id].add(r.text)
    rows = pii.personal_data(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        found = [base_spans(t) for t in texts[r.doc_id]]
        listed = [",".join(f"{k}:{a}:{e}" for a, _, k, e in x) for x in found]
        assert r.base_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in listed}
        assert any(set(filter(None, x.split(","))) <= set(r.spans.split(",")) for x in listed)
    assert pii.personal_data(empty(odd)).count() == 0


def test_zero_octets_and_spaced_cards(spark):
    texts = ["at 10.0.0.1 and 127.0.0.1", "0.0.0.0", "00.000.10.255 256.0.0.1", "192.168.0.5.", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        found = base_spans(texts[r.doc_id])
        assert found and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in found).encode()).hexdigest()
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got[0] == "at [IP] and [IP]" and got[4] == "[CARD]" and got[5] == "a [CARD] b"


def planted(n=240):
    """(id, text, kind, start, end) of personal data that no base pattern takes, in other sentences than the method's own; start -1: none."""
    shapes = [
        (0, "you may reach {} any day", ("lena (at) firma-k (dot) org", "tom.b [at] haus [dot] de", "r_king at school7 dot net")),
        (1, "the host {} went down", ("10 . 20 . 30 . 40", "172[.]16[.]5[.]9", "8 (dot) 8 (dot) 4 (dot) 4")),
        (2, "paid with card {} yesterday", ("4111.1111.1111.1111", "5500/0000/0000/0004", "4012_8888_8888_1881")),
        (3, "please call {} after six", ("(040) 777-1234", "0171-222-9876", "212.555.0187")),
        (-1, "section {} of the list", ("2.4, 3.1", "1299 items", "12:30:15:20", "77,12,9,4", "look at the dot matrix", "4111.1111.1111.1112", "300, 20, 4, 9")),
    ]
    out = []
    for i in range(n):
        kind, frame, values = shapes[i % 5]
        v = values[i // 5 % len(values)]
        text = ("intro " * (i % 4)) + frame.format(v)
        out.append((i, text, kind, text.index(v) if kind >= 0 else -1, text.index(v) + len(v) if kind >= 0 else -1))
    return out


def test_planted_spans_beyond_the_patterns(spark, docs):
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    trees = pii.fit(docs)
    got = {r.doc_id: set(filter(None, r.s.split(","))) for r in pii.spans(df, trees).select("doc_id", pii.listed("_more").alias("s")).collect()}
    want = {i: {f"{pii.KINDS[k]}:{a}:{b}"} if k >= 0 else set() for i, _, k, a, b in rows}
    hits, found, wanted = sum(len(got[i] & want[i]) for i in want), sum(map(len, got.values())), sum(map(len, want.values()))
    assert hits >= 0.95 * found and hits >= 0.8 * wanted, (hits, found, wanted)
    # without the trees nothing beyond the base patterns is found
    trees.thresholds = [float("inf")] * 4
    assert pii.spans(df, trees).where("size(_more) > 0").count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15), (2, None, None), (3, "call +1 (017) 555-7713, ip 1.2.3.4.", 0), (4, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[2].text is None
    assert got[3].text == "call [PHONE], ip [IP]." and got[4].text == "clean"


def test_trees_are_the_same_in_python_and_in_columns(spark):
    rng = np.random.default_rng(1)
    cells = [(tuple(int(x) for x in rng.integers(0, 4, len(pii.FEATURES))), 10, int(rng.integers(0, 11))) for _ in range(200)]
    trees = pii.Trees(cells)
    df = spark.createDataFrame([c for c, _, _ in cells], ", ".join(f"{f} int" for f in pii.FEATURES))
    scores = [r.s for r in df.select(trees.column(F.struct(*pii.FEATURES)).alias("s")).collect()]
    expected = [trees.start + sum(trees._value(t, c) for t in trees.trees) for c, _, _ in cells]
    assert np.allclose(scores, expected)


# ---- 3


def page(i, article=True):
    inner = f"<h1>Title {i} &amp; more</h1><p>First <b>bold</b> text {i}<br>goes on<p>Same line<ul><li>item {i}<li>two</ul>"
    body = f"<article>{inner}</article>" if article else f"<div id=c><div class=crumb>Home</div>{inner}<div class=shr>Share this</div></div>"
    return f"<html><head><title>t</title><script>var a='</p>'</script></head><body><div class=top>My site</div><nav>menu {i}</nav>{body}<div class='comments'><p>bad {i}</p></div><form>form</form><footer>foot</footer>"


def test_wrapper_induction(spark):
    rows = [(i, f"http://h/{i}", page(i, False)) for i in range(6)] + [(10, "http://g/1", page(10)), (11, None, None), (12, "odd", ""), (13, "http://g/2", "plain text")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, wrapper string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    expect = lambda i: f"Title {i} & more\n\nFirst bold text {i} goes on\n\nSame line\n\nitem {i}\n\ntwo"
    assert all(got[i].text == expect(i) for i in (0, 1, 2, 3, 4, 5, 10))
    assert got[11].text == got[12].text == "" and got[11].n_chars == 0 and got[13].text == "plain text"
    assert html.extract(empty(df)).count() == 0


def text(page, wrapper=None):
    return html.main_text(page, wrapper)[0]


def test_wrappers_decide_what_is_content(spark):
    """On the given pages too: without the wrappers' content element nothing is left."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    learnt = html.wrappers(pages)
    rows = html.extract(pages, learnt=learnt).collect()
    hosts = defaultdict(set)
    for r in pages.where("html <> ''").collect():
        hosts[re.match(r"\w+://([^/]+)", r.url)[1]].add(r.html)
    several = [r for r in rows if r.url and len(hosts[re.match(r"\w+://([^/]+)", r.url)[1]]) > 1]
    assert len(several) > 20 and all(r.way == "wrapper" and r.text for r in several)
    emptied = html.Wrapper([], [])
    assert all(html.main_text(r.html, emptied) == ("", "wrapper") for r in pages.limit(20).collect() if r.html)
    # names and tags that mean nothing: alignment alone tells the article from the advert and the footer
    def odd_page(i):
        return f"<div class=q1><span>Site</span></div><div class=q2><p>Buy now</p></div><div class=q3><h2>Head {i}</h2><p>{f'text {i} ' * 30}</p><p>Read also</p></div><div class=q4>All rights</div>"

    df = spark.createDataFrame([(i, f"http://odd/{i}", odd_page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in html.extract(df).collect():
        assert r.way == "wrapper" and r.text.split("\n\n") == [f"Head {r.page_id}", (f"text {r.page_id} " * 30).strip(), "Read also"]


def test_copies_tell_nothing(spark):
    same = "<div><h1>Title</h1><p>" + "all the same text " * 20 + "</p></div>"
    df = spark.createDataFrame([(i, f"http://c/{i}", same + f"<!-- {i} -->") for i in range(4)], "page_id long, url string, html string")
    rows = html.extract(df).collect()
    assert all(r.way == "page" and r.text.startswith("Title\n\nall the same") for r in rows)


def test_matching_equals_brute_force(monkeypatch):
    import random

    def brute(a, x, b, y):
        if a.label[x] != b.label[y]:
            return 0
        p, q = a.kids[x], b.kids[y]
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(a, c, b, d))
        return 1 + m[-1][-1]

    rng = random.Random(1)

    def made(depth):
        return "".join(f"<{t}>{made(depth - 1) if depth else 'x'}</{t}>" for t in (rng.choice(["div", "section", "ul"]) for _ in range(rng.randint(0, 3))))

    for cells in (html.MATRIX, 2):  # whole tables, and halved lists
        monkeypatch.setattr(html, "MATRIX", cells)
        for _ in range(150):
            a, b = html.parse(made(3)), html.parse(made(3))
            m = html.Matching(a, b)
            pairs = m.pairs()
            assert m.size(0, 0) == brute(a, 0, b, 0) == len(pairs)
            assert all(a.label[x] == b.label[y] for x, y in pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def test_no_article_text_is_dropped_by_size():
    long = "long text of the body, " * 40
    assert text(f"<div class=content><h1>Title</h1><p>lead</p><div class=body><p>{long}</p><p>{long}</p></div></div>").startswith("Title\n\nlead\n\nlong")
    assert text(f"<div><div class=links><a href=x>a link</a></div><div><h1><a href=x>Title</a></h1><div><p>{long}</p></div><div><p>short end</p></div></div></div>").split("\n\n") == ["Title", long.strip(), "short end"]
    assert text(f"<article><p>{long}</p></article><article><p>second part</p></article>").endswith("second part")
    assert text(f"<article><h1>Title</h1><div itemprop=articleBody><p>{long}</p></div></article><div itemprop=articleBody><p>end</p></div>").split("\n\n") == ["Title", long.strip(), "end"]
    assert text(f"<table><tr><td><a href=x>{long}</a><div><p>short text</p></div></td><td><p>{long}</p></td></tr></table>").count("short text") == 1


def test_deep_and_broken_pages():
    assert text("<div>" * 20_000 + "deep") == "deep"
    wide = "<ul>" + "".join(f"<li class=k{chr(97 + i % 7)}>{i}" for i in range(3000))
    assert text(wide).count("\n\n") == 2999 and html.Matching(html.parse(wide), html.parse(wide[: len(wide) // 2])).size(0, 0) > 1000
    for page_ in ("<div>" * 20_000 + "deep", "<p>" * 5000 + "x", "<a href='x", "<!-- open", "</p></p>a<b", "<table><tr><td>1<td>2<tr><td>3</table>"):
        html.main_text(page_)
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"


def test_encoder_cuts_only_before_single_spaces():
    from inkloom.llm import tokens

    enc = tokens.Encoder(tokens.default_path())
    called, whole = [], enc.whole
    enc.whole = lambda t: called.append(t) or whole(t)
    for t in ("", " ", " a", "a ", "a\n", "\n", "don't  ", " a b ", "a b\t", "a b.", "  ", "a  b", "a\n b", " \n x", "x\t y z ", "a\u3000 b", "a b  ", "\n a"):
        assert enc.encode(t) == (whole(t) if t else b""), repr(t)
    assert called[-7:] == ["a  b", "a\n b", " \n x", "x\t y z ", "a\u3000 b", "a b  ", "\n a"]
    assert not {" a", "a ", "a\n", "a b\t", "a b."} & set(called)


def test_features_drop_the_encoders_of_a_reused_worker():
    from inkloom.llm import tokens
    from inkloom.llm.linear import Space

    tokens.encoder(tokens.default_path())
    Space().rows(["some words"])
    assert tokens.encoder.cache_info().currsize == 0


def test_points_count_distinct_words_without_hashing_them_again(monkeypatch):
    from inkloom.llm import packing, textvec

    texts = ["a b a c", "", None, "one two one", "a", "x " * 50 + "y", "é a-b a"]
    naive = np.zeros((len(texts), packing.DIMS))
    for i, text in enumerate(texts):
        words = {int(h) >> 24 for h in textvec.Tokens([(text or "").encode()], words_only=True).hash}
        mixed = textvec.mix(np.array(sorted(words), np.uint64))
        for d in range(packing.DIMS):
            naive[i, d] = sum(1 - 2 * (int(m) >> d & 1) for m in mixed) / np.sqrt(max(len(words), 1))
    monkeypatch.setattr(np, "unique", None)  # hashes all words; sorting them takes a fraction of its time
    assert np.allclose(packing.project(texts), 1 / (1 + np.exp(-1.702 * naive)))
    assert packing.project([]).shape == (0, packing.DIMS) and len(packing.curve_keys(["", None])) == 2
