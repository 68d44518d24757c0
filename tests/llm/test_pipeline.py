"""The pipeline against a brute-force version of its five stages."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from guardspark.llm import common, language_id, sentencepiece_codec

from .test_operators import brute_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, profiles):
    ranks = language_id.Ranks(profiles)
    rows = [r for r in rows if (lambda f: f[0] != "und" and f[1] >= language_id.LEAST_SCORE)(ranks.nearest(r[1]))]
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    rows = [r for r in rows if best[r[1]] == r[0]]
    comp = brute_components(rows)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, full, target = 1.5 * sum(total.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        target.update({s: left * weight[s] / sum(weight[x] for x in free) for s in free})
        over = [s for s in free if target[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            full.add(s)
            left -= target[s]
    out = Counter()
    for s in names:
        at = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), size[r[0]])):
            for start in (at, at + total[s]):
                out[r[0]] += start < round(target[s])
            at += size[r[0]]
    return +out, {r[0]: r[1] for r in rows}


def test_pipeline(spark, tmp_path):
    draw = random.Random(2)
    stems = {"en": "the and thing that with from".split(), "de": "der die und nicht mit von".split()}
    rows = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        rows.append((k, " ".join(draw.choice(stems[lang]) + draw.choice(["", "er", "ing"]) for _ in range(draw.randint(6, 60))), lang, ["a", "b", None, "c"][k % 4], 0))
    rows += [(100 + k, rows[k][1], "en", "a", 0) for k in range(8)]
    rows += [(200 + k, rows[k + 20][1] + " more", "en", "b", 0) for k in range(8)]
    rows += [(300, None, None, "a", 0), (301, "", None, "b", 0), (302, "123 456", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    want, text = brute(rows, language_id.learn(docs))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter(r.doc_id for r in out) == want
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    assert all(codec.decode(r.ids) == text[r.doc_id] and r.n_tokens == len(r.ids) for r in out)
    stage = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert stage.columns == docs.columns


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_near_stage_links_from_four_fifths(spark):
    """Pairs at 0.8 and more, below op7's 0.85, become one; pairs just under 0.8 stay."""
    rows = []
    for k, (n, edits) in enumerate([(8, 1), (12, 2), (34, 6), (64, 15), (104, 25), (304, 70), (7, 1), (64, 16), (104, 26)]):
        words = [f"w{k}x{i}" for i in range(n)]
        # Sets of n - 4 + edits and n - 4 shingles, the second within the first.
        rows += [(10 * k, " ".join([*words, *(f"v{k}x{i}" for i in range(edits))])), (10 * k + 1, " ".join(words))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= x < 0.85 for x in likeness) >= 4 and min(likeness) < 0.8
    want = {10 * k for k in range(len(likeness))} | {10 * k + 1 for k, x in enumerate(likeness) if x < 0.8}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == want


def test_order_of_the_mix_reaches_the_ids(spark, tmp_path):
    """Over several files, which Spark reads in an order of its own."""
    draw = random.Random(12)
    rows = [(k, " ".join(draw.choice(["the", "and", "thing"]) for _ in range(draw.choice([1, 5, 400]))), "en", "abc"[k % 3], 0) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    path = f"file://{tmp_path}/mixed"
    with common.conf(spark, spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false"):
        corpus_pipeline.mixing_stage(spark, docs, "").write.option("maxRecordsPerFile", 15).parquet(path)
    mixed = spark.read.parquet(path)
    assert len(mixed.inputFiles()) > 10 and [r.doc_id for r in mixed.collect()] != [i for i, _ in want]
    assert [(r.doc_id, r.text) for r in common.as_written(mixed).collect()] == want
    ids = corpus_pipeline.encode_stage(spark, mixed, "").collect()
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    assert [(r.doc_id, codec.decode(r.ids)) for r in ids] == want
    made = spark.createDataFrame([(1, "a")], "doc_id int, _metadata string")
    assert common.as_written(made).collect() == made.collect() and common.as_written(spark.range(3)).count() == 3
