"""Ids beyond doubles beside nulls, columns whose names clash with working columns, and brute-force versions of scores."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardspark.llm import exact_dedup, language_id, minhash, mixing, quality, secret_scan, sentencepiece_codec, simhash, substring_dedup, token_store
from guardspark.llm.common import shared_dir

from .test_operators import prose

BIG = [2**53 + 1, 2**53 + 3, None, 2**60 + 7, -(2**60) - 9]
CLASHING = ["_at", "_text", "_id", "_metadata", "_row", "_row_", "_order", "score", "lang_pred", "digest", "row", "locator", "rep", "band", "key", "gram", "n", "kind", "fingerprint", "label", "start", "path", "order", "bucket", "ids2"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(31)
    key = hashlib.sha1(b"x").hexdigest()
    return [f'{prose(draw, 40)} token = "{key}" {prose(draw, 8)}' for _ in BIG]


@pytest.fixture(scope="module")
def big(spark, texts):
    """All rows in one batch, the null among them."""
    return spark.createDataFrame(list(zip(BIG, texts, ["en"] * 5, ["a"] * 5, [0] * 5, strict=True)), "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """A Parquet table with copies, near copies, nulls and a column of every name that an operator may use itself."""
    draw = random.Random(32)
    base = [prose(draw, 50) for _ in range(12)]
    rows = [(k, t, "en", "ab"[k % 2], 0) for k, t in enumerate([*base, *base[:3], *(b + " more" for b in base[3:6]), None, ""])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = f"file://{tmp_path_factory.mktemp('clash')}/documents.parquet"
    df.select("*", *[F.concat(F.lit(c + ":"), F.col("doc_id")).alias(c) for c in CLASHING]).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_ids_stay(spark, big):
    want = sorted(BIG, key=str)
    model = sentencepiece_codec.model_path()
    assert ids(sentencepiece_codec.encoded(big, model)) == want
    assert ids(sentencepiece_codec.decode_column(sentencepiece_codec.encode_column(big, model), model)) == want
    assert ids(secret_scan.scan(big, secret_scan.train(secret_scan.labelled_findings(300)))) == want
    assert ids(language_id.identify(big, language_id.learn(big))) == want
    assert ids(quality.score(big, quality.AttentionMil().fit(np.zeros((0, quality.FEATURES)), np.zeros(0, int), np.zeros(0)))) == want
    assert ids(simhash.with_classes(simhash.fingerprints(big))) == want
    near = minhash.near_duplicates(big).collect()
    assert sorted((r.doc_id for r in near), key=str) == want and all(r.component_id == r.doc_id for r in near)
    assert ids(exact_dedup.exact_dedup(big)) == want and ids(mixing.mix(big)) == want and ids(substring_dedup.deduplicate(big)) == want
    folder = shared_dir(spark, "store")
    token_store.write_store(big, folder, token_store.tokenizer_path())
    store = token_store.TokenStore(spark, folder)
    assert ids(store.documents()) == want and store.lookup(2**53 + 1) is not None and store.lookup(2**53) is None


def test_ids_of_text(spark, texts):
    """Ids need not be numbers where nothing orders them as such."""
    docs = spark.createDataFrame([("b", texts[0]), ("a", texts[0]), ("c", texts[1])], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
    near = simhash.with_classes(simhash.fingerprints(docs)).collect()
    assert sorted((r.doc_id, r.near_class, r.class_size, r.n_near) for r in near) == [("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 0)]
    assert ids(sentencepiece_codec.encoded(docs, sentencepiece_codec.model_path())) == ["a", "b", "c"]


def test_operators_beside_clashing_columns(spark, clashing):
    model, n = sentencepiece_codec.model_path(), clashing.count()
    assert sentencepiece_codec.encoded(clashing, model).count() == n and "score" in sentencepiece_codec.encode_column(clashing, model).columns
    assert secret_scan.scan(clashing, secret_scan.train(secret_scan.labelled_findings(300))).count() == 0
    assert secret_scan.frequent_words(clashing) == [] or secret_scan.corpus_findings(clashing) is not None
    assert exact_dedup.exact_dedup(clashing).count() == n
    assert language_id.identify(clashing, language_id.learn(clashing)).count() == n
    assert simhash.with_classes(simhash.fingerprints(clashing)).count() == n
    assert minhash.near_duplicates(clashing).count() == n and mixing.mix(clashing).count() == n and substring_dedup.deduplicate(clashing).count() == n
    labels = clashing.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.score(clashing, quality.learn(clashing, labels)).count() == n
    folder = shared_dir(spark, "store")
    token_store.write_store(clashing, folder, token_store.tokenizer_path())
    assert token_store.TokenStore(spark, folder).documents().count() == n


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_clashing_columns(spark, clashing, number):
    out = corpus_pipeline.STAGES[number][1](spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)


def test_mixing_of_repeated_ids(spark):
    """Rows that repeat an id are rows of their own, so a source comes near its target."""
    rows = [(1, " ".join(["a"] * k), "s") for k in (3, 5, 9)] + [(k, "b c d", "t") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = {"s": 0, "t": 0}
    for r in mixing.mixed_documents(docs).collect():
        size[r.source] += len(r.text.split())
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert target["s"] <= size["s"] < target["s"] + 9 and target["t"] <= size["t"] < target["t"] + 3


# 2


def test_keys_of_any_length_and_private_keys():
    body = "\n".join("Ab1+" * 16 for _ in range(20))
    whole = f"RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n{body}\n-----END RSA PRIVATE KEY"
    assert secret_scan.candidates(f"x -----BEGIN {whole}----- y") == [("private_key", 13, len(whole))]
    for n in (257, 10_000, 1_000_000):
        key = ("aB3" * n)[:n]
        text = f"the deploy key is {key} and token = '{key}'"
        assert secret_scan.candidates(text) == [("long_run", 18, n), ("assigned", text.index("'") + 1, n)]
        assert len(secret_scan.describe(text, 18, n, None, "long_run")) == len(secret_scan.describe("a b", 0, 1, "", "assigned"))


def test_many_candidates_are_linear():
    text = " ".join(f"token{k} = a1b2c3d4e5f6{k:06d}" for k in range(100_000))
    start = time.process_time()
    found = secret_scan.candidates(text)
    assert len(found) == 100_000 and time.process_time() - start < 10


def test_candidates_against_all_patterns_one_by_one():
    """First pattern first, none that overlaps an earlier one: as a plain double loop says."""
    draw = random.Random(5)
    parts = ["token = ", "AKIA" + "A1" * 8, "ghp_" + "aB3d" * 9, "https://u:hunter2x@h", "x" * 30 + "9", "password: changeme99", "eyJhbGciOi.eyJzdWIiOj.abcd", "plain", "-----BEGIN PRIVATE KEY-----", "=", " ", "\n", "é"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        want = []
        for name, pattern in secret_scan.PATTERNS:
            for m in pattern.finditer(text):
                a, b = m.span("v")
                mixed = any(map(str.isdigit, m["v"])) and any(map(str.isalpha, m["v"]))
                if (name != "long_run" or mixed) and all(b <= x or a >= x + n for _, x, n in want):
                    want.append((name, a, b - a))
        assert secret_scan.candidates(text) == sorted(want, key=lambda f: f[1])


def test_findings_of_documents(spark):
    """Planted keys are told from planted hashes, by a forest that learned from other documents."""
    draw = random.Random(6)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"{prose(draw, 20)} {'api_key = ' if k % 2 else 'commit '}{hexes(40)} {prose(draw, 20)}", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    words = secret_scan.frequent_words(docs)
    known = secret_scan.Dictionary(words)
    learned, held = secret_scan.corpus_findings(docs.where(~secret_scan.held_out())), secret_scan.corpus_findings(docs.where(secret_scan.held_out()))
    forest = secret_scan.train(learned, known)
    precision, recall = secret_scan.quality_of(forest, held, known)
    assert len(held) > 80 and precision > 0.97 and recall > 0.97 and set(WORDS_OF(docs)) & set(words)
    found = {r.doc_id: r.secret for r in secret_scan.scan(docs, forest, words=words).collect()}
    assert sum(found[k] == bool(k % 2) for k in found) >= 0.97 * len(rows)


def WORDS_OF(docs):
    return {w for r in docs.collect() for w in r.text.split() if len(w) >= 4}


def test_coverage_against_leftmost_longest():
    words = secret_scan.Dictionary(["passwords", "passw", "word"])
    assert words.coverage("xpasswordsx") == pytest.approx(9 / 11) and words.coverage("") == 0 and words.coverage("Password!") == pytest.approx(8 / 9)


# 4


def test_scores_against_plain_arithmetic(spark):
    """Attention and score of each document, passage by passage."""
    draw = random.Random(7)
    texts = [prose(draw, n) + draw.choice([".", "!!! | |", ""]) for n in (1, 39, 40, 41, 95, 200)] + ["", None, "a! b| c" * 900]
    model = quality.AttentionMil(3)
    model.mean, model.scale = np.full(quality.FEATURES, 0.1, np.float32), np.full(quality.FEATURES, 0.7, np.float32)
    got = model.score(texts)
    for text, mark in zip(texts, got, strict=True):
        x, counts = quality.passages([text])
        assert counts.sum() == max(1, math.ceil(len((text or "").split()) / quality.PASSAGE)) == len(x)
        total, z = 0.0, np.zeros(quality.HIDDEN)
        for row in np.clip((x - model.mean) / model.scale, -6, 6):
            h = np.tanh(row @ model.W + model.b)
            e = math.exp(float((np.tanh(h @ model.V) / (1 + np.exp(-(h @ model.U)))) @ model.w))
            total, z = total + e, z + e * h
        assert mark == pytest.approx(1 / (1 + math.exp(-float(z / total @ model.c + model.d[0]))), abs=1e-5)


def test_gradients_against_differences():
    draw = np.random.Generator(np.random.PCG64(1))
    x, counts, y = draw.normal(size=(7, quality.FEATURES)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionMil(2)
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    loss = lambda: -float(np.mean(y * np.log(p := model.forward(x, counts)["p"]) + (1 - y) * np.log(1 - p)))
    for name, g in model.gradients(x, counts, y).items():
        value = getattr(model, name)
        at = tuple(int(draw.integers(0, n)) for n in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# 5


def test_distances_against_plain_lists():
    """Out-of-place distance and winner, from sorted lists of n-grams."""
    draw = random.Random(8)

    def counted(text):
        count = {}
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            p = f" {w} "
            for n in (1, 2, 3):
                for k in range(len(p) - n + 1):
                    g = p[k : k + n]
                    if g.strip() and not (n == 3 and g[1] == " "):
                        count[g] = count.get(g, 0) + 1
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], packed(x[0])))[: language_id.PROFILE]]

    packed = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    corpus = {"x": prose(draw, 400), "y": " ".join(w[::-1] for w in prose(draw, 400).split()), "ä": "über die öde größe " * 30}
    lists = {k: counted(t) for k, t in corpus.items()}
    ranks = language_id.Ranks({k: [packed(g) for g in v] for k, v in lists.items()})
    for text in [prose(draw, 9), prose(draw, 60)[::-1], "größe über", "a", "日本 x1y", prose(draw, 5000), "tie", "É"]:
        own = counted(text)
        distance = {k: sum(abs(v.index(g) - r) if g in v else language_id.PROFILE for r, g in enumerate(own)) for k, v in lists.items()}
        best = min(sorted(distance), key=distance.get)
        assert ranks.nearest(text) == (best, pytest.approx(1 - distance[best] / (language_id.PROFILE * len(own))))


# very long texts


def test_very_long_texts(spark):
    """A megabyte without a space, and one with many; every operator takes them whole."""
    draw = random.Random(9)
    long = ["ab" * 500_000, " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit"]) + str(k % 977) for k in range(120_000))]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(long)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert all(r.decoded_same for r in sentencepiece_codec.encoded(docs, sentencepiece_codec.model_path()).collect())
    assert {r.doc_id: r.n_chars for r in simhash.fingerprints(docs).collect()} == {k: len(t) for k, t in enumerate(long)}
    assert {r.doc_id: r.n_bytes for r in substring_dedup.deduplicate(docs).collect()} == {k: len(t) for k, t in enumerate(long)}
    assert language_id.identify(docs, language_id.learn(docs)).where("lang_pred = 'en'").count() == 2
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.AttentionMil()).collect())
    assert sorted(r.n_shingles for r in minhash.near_duplicates(docs).collect())[0] == 1


def test_extreme_ids_come_back(spark):
    """The least and the greatest id beside null ones: each comes back as it is, and is looked up as itself."""
    draw = random.Random(41)
    shared = prose(draw, 40)
    rows = [(i, f"{shared} {prose(draw, 5)} {k}") for k, i in enumerate([-(2**63), None, 2**63 - 1, 7, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((i for i, _ in rows), key=str)
    out = substring_dedup.deduplicate(docs).collect()
    assert sorted((r.doc_id for r in out), key=str) == want
    # The smallest id keeps the shared passage; those without an id come last.
    assert {r.doc_id for r in out if not r.n_removed} == {-(2**63)}
    folder = shared_dir(spark, "extreme")
    token_store.write_store(docs, folder, token_store.tokenizer_path())
    store = token_store.TokenStore(spark, folder)
    encoder = token_store.encoder_at(token_store.tokenizer_path())
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in store.documents().collect())
    assert sorted((i for _, i, _ in found), key=str) == want and [i for _, i, _ in found] == [None, None, -(2**63), 7, 2**63 - 1]
    for i, text in rows:
        if i is not None:
            assert store.lookup(i) == np.frombuffer(encoder.encode(text), "<u4").tolist()
    empty = shared_dir(spark, "nameless")
    token_store.write_store(docs.where("doc_id is null"), empty, token_store.tokenizer_path())
    nameless = token_store.TokenStore(spark, empty)
    assert nameless.lookup(-(2**63)) is None and [r.doc_id for r in nameless.documents().collect()] == [None, None]


def test_web_tokens_cost_their_length():
    """A megabyte of beginnings of tokens; the places are those of the pattern."""
    pattern = dict(secret_scan.PATTERNS)["web_token"]
    draw = random.Random(6)
    atoms = ["eyJ", "-", ".", "aaaa", "bbbbbbbb", "_", " ", "eyJaaaaaaaa"]
    for _ in range(500):
        text = "".join(draw.choice(atoms) for _ in range(draw.randint(1, 40)))
        got = [s for m in secret_scan.TOKEN_RUN.finditer(text) for s in secret_scan.web_tokens(m[0], m.start())]
        assert got == [m.span("v") for m in pattern.finditer(text)], text
    start = time.process_time()
    assert secret_scan.candidates("-eyJaaaaaaaa" * 90_000) is not None and time.process_time() - start < 2
