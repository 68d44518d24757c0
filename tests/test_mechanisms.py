"""Holdback, resumable matching, event time and the mechanisms that the documentation describes, against brute force."""

import hashlib
import math
import random
import re
import shutil
import uuid
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guardspark.errors import ClassifierError, ConfigError
from guardspark.functions import lexicons as L
from guardspark.functions import text as T
from guardspark.operators import audit, classifiers, deobfuscate, drift, holdback, merkle, ml, phases, pipelines, policy, resume, selection
from guardspark.plans import govern, registry
from guardspark.plans.documented import SETS
from guardspark.plans.shipped import DEFAULT
from guardspark.sources import config, inherit
from guardspark.sources.config import Action, Policy, Rule, Trigger
from guardspark.streaming import eventtime, reload, stateful

TOKENS = "stream_id bigint, seq bigint, token string, done boolean"


def plan_of(*patterns, stop=None):
    rules = [Rule(f"r{k}", Trigger("pattern", pattern=p), (Action("redact"),)) for k, p in enumerate(patterns)]
    if stop:
        rules.append(Rule("stop", Trigger("pattern", pattern=stop), (Action("stop", message="ended"),)))
    return phases.Plan(policies=[Policy("p", tuple(rules))])


def brute_release(tokens, h, pattern, stop):
    """(seq, check, stopped, output) of one stream."""
    out, n = [], len(tokens)
    for check in range(1, -(-n // h.interval) + 1):
        top = min(check * h.interval, n)
        low = max(0, (check - 1) * h.interval - 2 * h.hold)
        text = "".join(t or "" for _, t in tokens[low:top])
        if stop and re.search(stop, text):
            return [*out, (tokens[top - 1][0], check, True, "ended")]
        mask = ["v"] * len(text)
        for m in re.finditer(pattern, text):
            mask[m.start() : m.end()] = "b" + "h" * (m.end() - m.start() - 1)
        at = 0
        for k in range(low, top):
            token = tokens[k][1] or ""
            if k >= (check - 1) * h.interval - h.hold and (top == n or k < top - h.hold):
                shown = "".join({"v": c, "b": "[REDACTED]", "h": ""}[m] for c, m in zip(token, mask[at : at + len(token)], strict=True))
                out.append((tokens[k][0], check, False, shown))
            at += len(token)
    return out


@pytest.mark.parametrize("hold,interval", [(3, 2), (4, 4), (0, 1), (2, 5)])
def test_release_in_batch_and_by_state(spark, tmp_path, hold, interval):
    draw, h = random.Random(hold), holdback.Holdback(hold, interval)
    atoms = ["ab", "12", "3-", "45", "-6", "789", " x", "é", "", None, "zz", "END"]
    streams = {s: [(10 * k, draw.choice(atoms[: 11 + (s % 3 == 0)])) for k in range(draw.choice([1, 4, 9, 23]))] for s in range(12)}
    rows = [(s, q, t, q == streams[s][-1][0]) for s in streams for q, t in streams[s]]
    plan = plan_of(r"\d\d+-\d+", stop="END")
    want = sorted((s, *r) for s in streams for r in brute_release(streams[s], h, r"\d\d+-\d+", "END"))
    batch = holdback.release(spark.createDataFrame(rows, TOKENS), h, plan)
    assert sorted(map(tuple, batch.collect())) == want
    # Three files, a batch each: the state goes on where it stopped.
    for n in range(3):
        part = [r for r in rows if (r[1] // 10) // 8 == n]
        spark.createDataFrame(part, TOKENS).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    stream = spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/[0-2]")
    assert sorted(map(tuple, stateful.release_stream(stream, h, plan).collect())) == want
    windows = holdback.windows(spark.createDataFrame(rows, TOKENS), h)
    assert max(len(r.parts) for r in windows.collect()) <= h.kept


def test_matchers_go_on_where_they_stopped():
    """After each chunk, what the state says is what the whole text so far says; the tails stay short."""
    patterns = [(p, False) for _, p in L.PII] + [("(ignore|disregard|forget).*(previous|above|instruction)", True), (r"\b\d{16}\b", False)]
    draw = random.Random(5)
    atoms = "123-45-6789|a.b@c.org|x|1|@|.|-| |\n|ignore|previous|above |forget it|4111 1111 1111 1111|555-123-4567|word |Über|instruction|great|bad|love|hell|terrible|I guarantee|act as".split("|")
    lists = [terms for *_, terms in classifiers.financial_advice().categories]
    for _ in range(300):
        text = "".join(draw.choice(atoms) for _ in range(draw.randint(1, 25)))
        matchers = [resume.Exists(*p) for p in patterns] + [resume.Count(L.POSITIVE), resume.Count(L.NEGATIVE), resume.Distinct(L.TOXIC), resume.First(lists)]
        states, at = [m.start for m in matchers], 0
        while at < len(text):
            n = draw.choice([1, 1, 2, 3, 7, 20])
            so_far = text[: at + n]
            want = [bool(re.search(p, so_far, re.I if i else 0)) for p, i in patterns]
            want += [len(re.findall(T.any_of(t), so_far, re.A)) for t in (L.POSITIVE, L.NEGATIVE)]
            want += [sum(t in so_far.lower() for t in set(L.TOXIC)), next((k for k, t in enumerate(lists) if re.search(T.any_of(t), so_far, re.A)), len(lists))]
            got = []
            for k, m in enumerate(matchers):
                states[k], value = m.step(states[k], text[at : at + n])
                got.append(value)
            assert got == want, so_far
            at += n
    scan = resume.scan_for(pipelines.Pipeline().single("t", classifiers.Toxicity()).single("p", classifiers.Pii()), [DEFAULT])
    state = scan.scan.start
    for k in range(5000):
        state, _ = scan.scan.step(state, "forget all of it 1234 " if k % 2 else "and so on, ")
    assert len(str(state)) < 1000
    with pytest.raises(ValueError):
        resume.Exists(r"a[^x]+b")


def test_a_stream_costs_its_length(spark):
    """Egress of a stream of many chunks; classifiers that can't be resumed get the whole prefix and say the same."""
    rows = [(s, k, "you are an idiot " if (s, k) == (1, 900) else "so it goes " if k % 50 else "hell ") for s in range(2) for k in range(1500)]
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, chunk string")
    pipeline = pipelines.Pipeline().single("t", classifiers.Toxicity())
    rule = Rule("tox", Trigger("classifier", classifier="toxicity", threshold=0.6), (Action("stop"),))
    plan = phases.Plan(egress=pipeline, policies=[Policy("p", (rule,))])
    out = phases.stream_egress(df, plan)
    text = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in text and "prefix" not in text
    got = {(r.stream_id, r.seq): r.output for r in out.collect()}
    assert max(k for s, k in got if s == 0) == 1499 and max(k for s, k in got if s == 1) == 900 and got[1, 900] == "[REDACTED]"

    other = phases.Plan(egress=pipelines.Pipeline().single("s", classifiers.Sequence()), policies=[Policy("p", (rule,))])
    assert "prefix" in phases.stream_egress(df, other)._jdf.queryExecution().analyzed().toString()


def test_sessions_by_event_time(spark, tmp_path):
    """Any order of arrival within the delay gives the same rows; late rows are counted; a tick after everything empties the state."""
    schema = "stream_id bigint, seq bigint, ts timestamp, chunk string"
    begin = datetime(2024, 1, 1)
    rows = [(k % 5, k, begin + timedelta(seconds=20 * k + (4000 if k > 150 else 0)), f"c{k}" if k % 7 else None) for k in range(300)]
    tick, late = (99, 10_000, begin + timedelta(days=2), "tick"), (0, 20_000, begin, "late")
    s = eventtime.Sessions(delay_ms=600_000, gap_ms=1_800_000)

    def run(name, files):
        reports = []
        for n, part in enumerate(files):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n}")
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/*")
            out, report = eventtime.run_sessions(source, s, state=str(tmp_path / f"{name}-state"))
            reports.append(report)
        return sorted(map(tuple, out.where("stream_id < 99").collect())), reports

    whole, reports = run("whole", [[*rows, tick]])
    assert sum(r[5] for r in whole) == 10 and sum(not r[5] for r in whole) == 300
    assert {r[1]: r[4] for r in whole if not r[5]}[10] == " c5 c10"
    mixed = rows[:]
    for at in range(0, 300, 25):
        part = mixed[at : at + 25]
        random.Random(at).shuffle(part)
        mixed[at : at + 25] = part
    got, reports = run("parts", [mixed[k : k + 40] for k in range(0, 300, 40)] + [[tick], [late]])
    assert got == whole and [r.late for r in reports] == [0] * 9 + [1]
    assert reports[0].streams_held == 5 and reports[-1].streams_held == 1


def _sessions_and_sql(spark, folder):
    """The rows of ``st_sessions`` and of its SQL, times by the clock that the table shows."""
    got = registry.QUERIES["st_sessions"](spark, str(folder)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = c.execute(registry.ORACLE["st_sessions"]).fetchall()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want))


def test_sessions_of_null_event_types_equal_sql(spark, tmp_path):
    """A null type adds nothing to a context, an empty one its delimiter; a context of nulls is null. Also beside equal times and ids."""
    with duckdb.connect() as c:
        kind = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END"
        c.execute(f"COPY (SELECT event_id, ts, user_id, {kind} AS event_type FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    got, want = _sessions_and_sql(spark, tmp_path)
    assert any(", None, False, " in r for r in want) and got == want

    rows = [(1, 1, datetime(2024, 1, 1), None), (1, 1, datetime(2024, 1, 1), "a"), (1, 1, datetime(2024, 1, 1), None), (2, 2, datetime(2024, 1, 2), "b")]
    spark.createDataFrame(rows, "stream_id bigint, seq bigint, ts timestamp, chunk string").coalesce(1).write.parquet(f"{tmp_path}/same")
    source = spark.readStream.schema("stream_id bigint, seq bigint, ts timestamp, chunk string").parquet(f"{tmp_path}/same")
    out, _ = eventtime.run_sessions(source, eventtime.Sessions(skip_null=True))
    assert [r.context for r in out.where("not closed").orderBy("n").collect()] == [None, None, "a"]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_sessions_in_another_time_zone_equal_sql(spark, zone):
    """The watermark counts from 1970, so a step must not take its times by the session's clock."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    got, want = _sessions_and_sql(other, "/root/testdata/sf0.001")
    assert got == want


def test_proofs_carry_no_block_a_leaf(spark):
    """Leaves meet their block as one row, so the plan has no row of a leaf beside a block's levels; proofs over several heights hold."""
    events = spark.range(3000).select(F.lit("a").alias("chain"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    leaves = merkle.numbered(events)
    built = merkle.trees(events, leaves)
    out = merkle.proofs(built, leaves.join(merkle.roots(built), "chain"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 2 and built.agg(F.max("height")).first()[0] == merkle.HEIGHT
    got = out.select("seq", "leaf", F.size("steps").alias("n"), merkle.proven(F.col("hash"), F.col("steps"), F.col("root")).alias("valid")).collect()
    assert len(got) == 3000 and all(r.valid and r.seq == r.leaf for r in got) and max(r.n for r in got) == 12


def test_scores_that_no_rule_reads_are_not_computed(spark):
    """Nested triggers count, disabled rules don't; the plan of a policy has no term of a classifier that it doesn't read."""
    tox, adv = Trigger("classifier", classifier="toxicity", threshold=0.1), Trigger("classifier", classifier="financial-advice", threshold=0.1)
    rules = (Rule("a", Trigger("composite", operator="or", triggers=(tox, Trigger("pattern", pattern="x"))), ()), Rule("b", adv, (), enabled=False))
    assert policy.classifiers(policy.triggers([Policy("p", rules)])) == {"toxicity"}
    plan = govern.evaluated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bastard" in plan and "fantastic" not in plan and "jailbreak" not in plan and "capital gains tax" not in plan
    low = spark.createDataFrame([("A\u017fB\u212a",), ("FEE",), (None,)], "t string").select(T.folded(F.col("t")).alias("t")).collect()
    assert [r.t for r in low] == ["asbk", "fee", None]


def test_windows_are_built_a_check_at_a_time(spark):
    """Tokens are grouped by check before a frame looks back, for any hold and interval, without a further shuffle."""
    tokens = spark.range(90).select((F.col("id") % 2).alias("stream_id"), F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("token"))
    for h in (holdback.Holdback(16, 8), holdback.Holdback(3, 4), holdback.Holdback(0, 5), holdback.Holdback(7, 1)):
        df = holdback.windows(tokens, h)
        for r in df.collect():
            top = min(r.check * h.interval, 45)
            assert [p.k for p in r.parts] == list(range(max(1, h.oldest(r.check)), top + 1)) and r.final == (top == 45)
            assert [p.seq for p in r.parts] == [2 * (p.k - 1) + r.stream_id for p in r.parts]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(own" in plan and "collect_list(struct(k" in plan


# What the documentation describes


def test_decided_rows_never_reach_python(spark, tmp_path):
    """Rows that a stage lets out don't pass the model; the others' scores are normalised."""
    folder = str(tmp_path)

    def load():
        def score(texts):
            for t in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return pd.DataFrame({"label": "m", "score": [3.0] * len(texts)})

        return score

    spec = {"stages": [
        {"type": "single", "name": "a", "classifier": "toxicity", "exit_on": "match"}, {"type": "single", "name": "b", "classifier": "pii", "exit_on": "threshold", "threshold": 0.9},
        {"type": "single", "name": "c", "classifier": "model", "transform": {"type": "normalize", "min": 1, "max": 5}}, {"type": "single", "name": "d", "classifier": "sentiment"},
    ]}
    texts = ["you idiot", "mail a@b.org", "so it goes", None, "", "all is great"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pipeline = pipelines.from_config("p", spec, classifiers.built_in() | {"model": classifiers.VectorClassifier("model", load)})
    got = {r.id: [(x.stage, x.result.score) for x in r.results] for r in pipeline.run(df).collect()}
    assert [s for s, _ in got[0]] == ["a"] and [s for s, _ in got[1]] == ["a", "b"]
    assert all([s for s, _ in got[k]] == ["a", "b", "c", "d"] and got[k][2][1] == 0.5 for k in (2, 3, 4, 5))
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["", "", "all is great", "so it goes"]
    with pytest.raises(ValueError):
        pipelines.from_config("p", {"stages": [{"type": "single", "name": "a", "classifier": "pii", "exit_on": "sometimes"}]})
    with pytest.raises(ValueError):
        pipelines.transform({"type": "normalize", "min": 1, "max": 1})


def brute_fold(text):
    """Folded text, and each character's place in the source."""
    cuts = [(m.start(), m.end()) for m in re.finditer(deobfuscate.CUT, text)]
    gone = set()
    for k, (a, b) in enumerate(cuts):
        before = a - (cuts[k - 1][1] if k else 0)
        after = (cuts[k + 1][0] if k + 1 < len(cuts) else len(text)) - b
        if all(c in deobfuscate.ZERO_WIDTH for c in text[a:b]) or before == after == 1:
            gone |= set(range(a, b))
    table = dict(zip(deobfuscate.FROM, deobfuscate.TO, strict=True))
    kept = [k for k in range(len(text)) if k not in gone]
    return "".join(table.get(text[k], text[k]) for k in kept), kept


def test_hidden_terms_are_found_in_the_source(spark):
    draw = random.Random(9)
    atoms = ["g u a r a n t e e d", "risk​ free", "R1SK FR33", "gսаrаntееd", " ", ".", "x", "é", "日本", "word", "-", "G.U.A.R.A.N.T.E.E.D", "🎉", "​", "a", "\n"]
    texts = ["".join(draw.choice(atoms) for _ in range(draw.randint(0, 40))) for _ in range(150)] + [None, "", "word " * 3000 + "g u a r a n t e e d"]
    rows = list(enumerate(texts))
    got = deobfuscate.protect(spark.createDataFrame(rows, "id int, text string"), ["guaranteed", "risk free"], replacement="#").collect()
    for r in got:
        text = texts[r.id] or ""
        folded, place = brute_fold(text)
        spans = [(place[m.start()], place[m.end() - 1] + 1) for m in re.finditer("guaranteed|risk free", folded)]
        out, at = "", 0
        for a, b in spans:
            out, at = out + text[at:a] + "#", b
        assert (r.protected or "") == out + text[at:]
        assert [(s.start, s.end) for s in r.spans or []] == [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    assert sum(len(r.hits) for r in got) > 100


def test_drift_adds_up(spark):
    """Sketches of parts make the sketch of the whole; the same words as the baseline's are no drift."""
    rows = [(k % 4, "the sun is great today" if k % 4 else f"zq{k} xv{k} terrible") for k in range(80)]
    df = spark.createDataFrame(rows, "conv int, text string")
    base = drift.Baseline.of(df.where("conv > 0"))
    whole = sorted(map(tuple, base.sketch(df, "conv").collect()))
    parts = base.sketch(df.where("length(text) > 20"), "conv").unionByName(base.sketch(df.where("length(text) <= 20"), "conv"))
    assert sorted((r.conv, r.bucket, r.n, r.rare) for r in drift.merged(parts, "conv").collect()) == whole
    got = {r.conv: r for r in drift.drift(df, base, "conv", limit=0.5).collect()}
    assert got[0].drifted and got[0].rare_ratio == 1 and got[0].kl > 0.5 and not any(got[k].drifted or got[k].rare_ratio for k in (1, 2, 3))
    assert drift.drift(df.where("false"), base, "conv").count() == 0


def test_reservoirs_merge(spark):
    df = spark.createDataFrame([(k, k % 3, (k % 11) / 10) for k in range(600)], "id int, s int, p double")
    keyed = selection.with_keys(df, "id", selection.entropy(F.col("p")), 4)
    whole = sorted((r.s, r.rank, r.id) for r in selection.reservoir(keyed, 7, "id", "s").collect())
    parts = selection.reservoir(keyed.where("id < 250"), 7, "id", "s").unionByName(selection.reservoir(keyed.where("id >= 250"), 7, "id", "s"))
    assert sorted((r.s, r.rank, r.id) for r in selection.reservoir(parts, 7, "id", "s").collect()) == whole and len(whole) == 21
    sure = {r.id for r in keyed.collect()}
    assert not any(k % 11 in (0, 10) for k in sure)
    # The likelier, the less sure: 0.5 beats 0.1.
    picks = [k for seed in range(20) for k in (r.id % 11 for r in selection.reservoir(selection.with_keys(df, "id", selection.margin(F.col("p")), seed), 30, "id").collect())]
    assert picks.count(5) > 2 * picks.count(1)


def test_policies_inherit():
    sets = {n: inherit.PolicySet.from_yaml(t) for n, t in SETS.items()}
    rules = inherit.resolve("house", sets)
    assert [(r.rule.name, r.policy, r.mode, r.priority) for r in rules] == [
        ("toxic", "base", "enforce", 90), ("promise", "money", "shadow", 70), ("invest", "money", "enforce", 70), ("pirates", "house", "enforce", 70), ("praise", "base", "enforce", 50), ("old", "house", "disabled", 50),
    ]
    loop = {"a": inherit.PolicySet("a", (), ("b",)), "b": inherit.PolicySet("b", (), ("c",)), "c": inherit.PolicySet("c", (), ("b",))}
    with pytest.raises(ConfigError, match="b extends c extends b"):
        inherit.resolve("a", loop)
    with pytest.raises(ConfigError, match="a extends b, which isn't there"):
        inherit.resolve("a", {"a": loop["a"]})
    for bad in ("name: x\npolicies: [{name: r, mode: maybe, trigger: {type: pattern, pattern: a}, action: stop}]", "name: x\npolicies: [{name: r, action: stop}]", "[]"):
        with pytest.raises(ConfigError):
            inherit.PolicySet.from_yaml(bad)


def test_policy_sets_of_a_folder(tmp_path):
    (tmp_path / "base.yaml").write_text(SETS["base"])
    (tmp_path / "more.yaml").write_text('name: more\nextends: "./base.yaml"\npolicies: []')
    assert [r.rule.name for r in inherit.resolve("more.yaml", inherit.load_sets(tmp_path))] == ["toxic", "praise", "old"]


@pytest.mark.parametrize("height", [2, 10])
def test_merkle_trees(spark, monkeypatch, height):
    """Roots as a plain recomputation has them; proofs hold for their event alone; each change is found."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    sizes = {"a": 1, "b": 2, "c": 7, "d": 33, "e": 64}
    rows = [(c, 10 * k, "t", f"{c}{k}", datetime(2024, 1, 1)) for c, n in sizes.items() for k in range(n)]
    chained = merkle.saved(audit.chain(spark.createDataFrame(rows, "chain string, seq bigint, event_type string, data string, ts timestamp")), "test-chain")
    events = {(r.chain, r.seq): r.hash for r in chained.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def root(chain):
        level = [sha("leaf:" + events[chain, 10 * k]) for k in range(sizes[chain])]
        while len(level) > 1:
            level = [sha(f"node:{level[k]}:{level[k + 1]}") if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    built = merkle.trees(chained)
    assert {r.chain: r.root for r in merkle.roots(built).collect()} == {c: root(c) for c in sizes}
    proofs = merkle.proofs(built, merkle.numbered(chained)).join(merkle.roots(built), "chain")
    own = merkle.proven(F.col("hash"), F.col("steps"), F.col("root"))
    got = proofs.select("chain", "leaf", own.alias("own"), merkle.proven(F.lit("x"), F.col("steps"), F.col("root")).alias("other")).collect()
    assert len(got) == len(rows) and all(r.own and not r.other for r in got)
    assert {r.valid for r in audit.verify(chained.repartition(7)).collect()} == {True} and audit.breaks(chained).count() == 0
    changed = chained.where("not (chain = 'd' and seq = 100)").withColumn("data", F.when((F.col("chain") == "e") & F.col("seq").isin(0, 330), "forged").otherwise(F.col("data")))
    assert sorted(map(tuple, audit.breaks(changed).collect())) == [("d", 110), ("e", 0), ("e", 330)]
    assert {r.chain for r in audit.verify(changed).collect() if not r.valid} == {"d", "e"}


def test_policies_reload_while_a_stream_runs(spark, tmp_path):
    """A rule changes between batches: each row has one version, and a batch that runs again keeps its own."""
    table, state = reload.PolicyTable(spark, f"file://{tmp_path}/policies"), f"file://{tmp_path}/state"
    schema = "id int, text string"
    rule = "name: p\nrules: [{{name: {0}, trigger: {{type: pattern, pattern: {0}}}, actions: [{{type: stop}}]}}]"
    with pytest.raises(ConfigError):
        table.publish(["rules: 7"])
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{tmp_path}/in/0")
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    with pytest.raises(Exception, match="holds no policies"):
        reload.judge_stream(source(), table, state=state)
    assert table.publish([rule.format("a")]) == 1
    reload.judge_stream(source(), table, state=state)
    assert table.publish([rule.format("b"), rule.format("c")]) == 2
    # The first batch is lost with its commit: it runs again, by the version that it noted.
    shutil.rmtree(tmp_path / "state/checkpoint")
    shutil.rmtree(tmp_path / "state/out")
    reload.judge_stream(source(), table, state=state)
    spark.createDataFrame([(3, "a"), (4, "b c"), (5, None)], schema).write.parquet(f"{tmp_path}/in/1")
    got = sorted((r.id, r.version, r.rules, r.should_stop) for r in reload.judge_stream(source(), table, state=state).collect())
    assert got == [(1, 1, ["a"], True), (2, 1, [], False), (3, 2, [], False), (4, 2, ["b", "c"], True), (5, 2, [], False)]


def test_defaults_and_names():
    """Settings that come with the engine."""
    a, m, s = config.AuditConfig(), config.ModelConfig("m"), config.ServiceConfig()
    assert (a.max_file_bytes, a.max_file_seconds, a.retention_days, a.flush_seconds) == (104857600, 86400, 90, 10)
    assert (m.revision, m.pooling, m.device, m.max_length, m.batch_size, m.quantization) == ("main", "mean", "cpu", 512, 1, "int8_dynamic")
    assert (s.token_holdback, s.max_buffer_capacity, s.timeout_ms, s.context_chunks, s.max_buffer_size) == (10, 1000, 10, 5, 100)
    assert (Action("stop").level, Action("stop").status_code, Action("stop").position) == ("info", 403, "after")


def test_a_head_from_its_file(spark, tmp_path):
    """Vectors that are null, short or long; files that are no heads; two labels and their threshold."""
    np.savez(tmp_path / "two.npz", labels=np.array(["no", "yes"]), weights=np.array([[0.0, 0.0], [1.0, -1.0]]), bias=np.zeros(2))
    head = ml.SequenceHead.from_file(tmp_path / "two.npz", threshold=0.6)
    rows = [(0, [2.0, 0.0]), (1, None), (2, []), (3, [0.1]), (4, [0.0, 5.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r.id: (r.r.label, round(r.r.score, 6)) for r in classifiers.with_results(df, {"r": ml.head_classifier("h", head)}, "v").collect()}
    logistic = lambda x: round(1 / (1 + math.exp(-x)), 6)
    assert got == {0: ("yes", logistic(2)), 1: ("no", 0.5), 2: ("no", 0.5), 3: ("no", logistic(float(np.float32(0.1)))), 4: ("no", logistic(-5))}
    np.savez(tmp_path / "bad.npz", labels=np.array(["no"]), weights=np.zeros((2, 2)), bias=np.zeros(2))
    for name in ("bad.npz", "none.npz"):
        with pytest.raises(ClassifierError):
            ml.SequenceHead.from_file(tmp_path / name)


def test_terms_in_the_source_as_in_pieces(spark):
    """Patterns over the source find what the pieces find, and look at pieces only where a cut has letters."""
    draw, parts = random.Random(5), ["g", "u", "a", "risk", "free", "r", " ", " ", "  ", "-", ".", "\u200b", "\u00e9", "|", "~", "\U0001f600", "$", "4", "\u0430", "\n", "3", "\uff47", "R"]
    phrases = ["g u a r a n t e e d", "risk free", "r.i.s.k free", "ri\u200bsk free", "guar\u200b anteed", "6uaranteed", "r i s k f r e e", "\U0001f600 g u a r a n t e e d", "risk f r e e"]
    rows = [(k, "".join(draw.choice(parts) if draw.random() < 0.7 else draw.choice(phrases) for _ in range(draw.randint(0, 9)))) for k in range(2000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    both = [sorted(f(df).select("id", "hits", "spans", "protected").collect()) for f in (lambda d: deobfuscate.protect(d, ["guaranteed", "risk free"]), lambda d: deobfuscate.by_pieces(d, ["guaranteed", "risk free"], "text", "[REDACTED]"))]
    assert both[0] == both[1] and sum(bool(r["hits"]) for r in both[0]) > 500


@pytest.mark.parametrize("name", ["cfg_misc", "src_yaml_classifiers", "clf_tier_budget"])
def test_classifiers_of_several_names_run_once(spark, name):
    """Pipelines and names that share a classifier share its patterns; words aren't split."""
    from guardspark.plans import registry

    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("(?i)dan mode") == 1 and "split(" not in plan


def test_words_counted_as_in_a_split(spark):
    rows = [("Good good,BAD-worst goodness xgood",), ("",), ("never exceeded 4good5 \u00e9bad",), ("GREAT",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "text string").select(*classifiers.Sequence().base(F.col("text")).values()).collect()]
    words = [[w.lower() for w in re.split("[^A-Za-z]+", t)] if t is not None else None for (t,) in rows]
    assert got == [tuple(None if w is None else float(sum(x in terms for x in w)) for terms in (L.SEQUENCE_POSITIVE, L.SEQUENCE_NEGATIVE)) for w in words]


@pytest.mark.parametrize("name", ["udf_loader", "st_release"])
def test_python_takes_small_batches(spark, name):
    """Memory of a Python worker doesn't grow with the rows of its task."""
    from guardspark.plans import registry

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() and int(spark.conf.get(key)) == 512
    finally:
        spark.conf.unset(key)
