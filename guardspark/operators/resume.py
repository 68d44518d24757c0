"""Judging a growing text chunk by chunk without keeping it.

What the egress classifiers and the stop rules need of all text so far (which terms occur, how often, whether a pattern matches) is advanced
by each chunk from a small state: what was found, and a tail of the text in which a match could still be under way. A match that touches the
text's end isn't settled, as the next character may end it (word borders); its characters are in the tail and are looked at again.

* terms: the tail is shorter than the longest term;
* a pattern of bounded width: as many characters, and the one before;
* ``A.*B`` of two such patterns: the first ``A`` of the line stands for all up to the last characters that ``B`` can take;
* any other pattern that takes no white space (an address): the last run without white space.

So a stream costs its length, and its state is bounded by the patterns (in the last case by the longest run without white space).
Patterns of another form can't be resumed; :func:`scan_for` says so, and callers fall back to the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from guardspark.functions import lexicons as L
from guardspark.functions import text as T
from guardspark.operators import classifiers as C
from guardspark.operators import policy
from guardspark.operators.pipelines import Pipeline, final, score_map
from guardspark.sources.config import Policy, Trigger

_parser = re._parser  # type: ignore[attr-defined]


class Distinct:
    """Number of the terms that occur in the lower-case text; state: bits of those found, and the tail."""

    kind, start = "int", (0, "")

    def __init__(self, terms: list[str]):
        self.terms = list(dict.fromkeys(terms))
        self.keep = max(map(len, self.terms), default=1) - 1

    def step(self, state: tuple, chunk: str) -> tuple[tuple, int]:
        found, tail = state
        text = tail + chunk.lower()
        for k, t in enumerate(self.terms):
            if not found >> k & 1 and t in text:
                found |= 1 << k
        return (found, text[len(text) - self.keep :] if len(text) > self.keep else text), found.bit_count()


class First:
    """Number of the first list of terms of which one occurs, in any ASCII case; their number if none does."""

    kind = "int"

    def __init__(self, lists: list[list[str]]):
        self.patterns = [re.compile(T.any_of(t), re.ASCII) for t in lists]
        self.keep = max(len(t) for terms in lists for t in terms) - 1
        self.start = (len(lists), "")

    def step(self, state: tuple, chunk: str) -> tuple[tuple, int]:
        least, tail = state
        text = tail + chunk
        least = next((k for k, p in enumerate(self.patterns[:least]) if p.search(text)), least)
        return (least, text[len(text) - self.keep :] if len(text) > self.keep else text), least


class Count:
    """Number of occurrences of terms that don't overlap, in any ASCII case; the tail begins behind the last of them."""

    kind, start = "double", (0, "")

    def __init__(self, terms: list[str]):
        low = [t.lower() for t in terms]
        if any(a != b and a in b[1:-1] for a in low for b in low):
            raise ValueError("a term lies inside another one")
        self.pattern = re.compile(T.any_of(terms), re.ASCII)
        self.keep = max(map(len, terms)) - 1

    def step(self, state: tuple, chunk: str) -> tuple[tuple, float]:
        n, tail = state
        text, end = tail + chunk, 0
        for m in self.pattern.finditer(text):
            n, end = n + 1, m.end()
        return (n, text[max(end, len(text) - self.keep) :]), float(n)


def leaves(tokens) -> Iterator[tuple]:
    """The parts of a parsed pattern that take a character."""
    for op, arg in tokens:
        if op is _parser.SUBPATTERN:
            yield from leaves(arg[3])
        elif op is _parser.BRANCH:
            for branch in arg[1]:
                yield from leaves(branch)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            yield from leaves(arg[2])
        elif op is not _parser.AT:
            yield op, arg


def takes_space(pattern: str) -> bool:
    def may(op, arg) -> bool:
        if op is _parser.LITERAL:
            return chr(arg).isspace()
        if op is not _parser.IN or arg[0][0] is _parser.NEGATE:
            return True
        return any(may(o, a) if o is _parser.LITERAL else any(a[0] <= ord(c) <= a[1] for c in " \t\n\r\f\v") if o is _parser.RANGE else a not in (_parser.CATEGORY_DIGIT, _parser.CATEGORY_WORD) for o, a in arg)

    return any(may(op, arg) for op, arg in leaves(_parser.parse(pattern)))


def width(pattern: str) -> int | None:
    """Characters of the longest match, None if there is no bound."""
    most = _parser.parse(pattern).getwidth()[1]
    return None if most > 10_000 else most


class Exists:
    """Whether a pattern matches; state: whether a match is settled, whether there is a character before the tail, and the tail."""

    kind = "boolean"

    def __init__(self, pattern: str, insensitive: bool = False):
        flags = re.IGNORECASE if insensitive else 0
        self.pattern, self.width, self.parts = re.compile(pattern, flags), width(pattern), None
        halves = pattern.split(".*")
        if self.width is None and len(halves) == 2 and all(h.count("(") == h.count(")") and "|" not in re.sub(r"\([^()]*\)", "", h) and width(h) for h in halves):
            self.parts = re.compile(halves[0], flags), width(halves[0]), width(halves[1])
        elif self.width is None and takes_space(pattern):
            raise ValueError(f"can't resume {pattern}")
        self.start = (False, 0, "")

    def step(self, state: tuple, chunk: str) -> tuple[tuple, bool]:
        settled, left, tail = state
        if settled:
            return state, True
        text = tail + chunk
        hit = False
        for m in self.pattern.finditer(text, left):
            hit = True
            if m.end() < len(text):
                return (True, 0, ""), True
        return (False, *self.cut(text, left)), hit

    def cut(self, text: str, left: int) -> tuple[int, str]:
        """Whether the tail's first character is only what stands before it, and the tail."""
        if self.parts:
            first, before, after = self.parts
            line = text.rfind("\n") + 1
            m = first.search(text, max(left, line))
            if m and m.end() < len(text):
                # All of a line behind its first A is as good as its last characters.
                rest = text[m.end() :]
                keep = text[max(m.start() - 1, 0) : m.end()] + rest[max(0, len(rest) - after - 1) :]
                return int(m.start() > 0), keep
            return self.last(text, left, before + after + 1)
        if self.width is not None:
            return self.last(text, left, self.width)
        at = max((k for k, c in enumerate(text) if c.isspace()), default=-1)
        return (left, text) if at < 0 else (1, text[at:])

    @staticmethod
    def last(text: str, left: int, n: int) -> tuple[int, str]:
        return (left, text) if len(text) <= n + 1 else (1, text[len(text) - n - 1 :])


Matcher = Distinct | First | Count | Exists


@dataclass
class Scan:
    """Matchers by the name of the column that each fills."""

    matchers: dict[str, Matcher]

    @property
    def start(self) -> tuple:
        return tuple(m.start for m in self.matchers.values())

    def step(self, state: tuple, chunk: str | None) -> tuple[tuple, tuple]:
        done = [m.step(s, chunk or "") for m, s in zip(self.matchers.values(), state, strict=True)]
        return tuple(s for s, _ in done), tuple(v for _, v in done)


def of_classifier(c: C.Classifier) -> dict[str, Matcher]:
    """Matchers for the base of a classifier."""
    if isinstance(c, C.Toxicity):
        return {"n": Distinct(L.TOXIC)}
    if isinstance(c, C.Sentiment):
        return {"pos": Count(L.POSITIVE), "neg": Count(L.NEGATIVE)}
    if isinstance(c, C.Pii):
        return {k: Exists(p) for k, p in L.PII}
    if isinstance(c, C.Cascade):
        return {"k": First([terms for *_, terms in c.categories])}
    if isinstance(c, C.Noop):
        return {}
    raise ValueError(f"classifier {c.name} can't be resumed")


def of_trigger(t: Trigger) -> dict[tuple, Matcher]:
    """Matchers below a trigger; classifier triggers need none."""
    if t.type == "composite":
        return {k: m for x in t.triggers for k, m in of_trigger(x).items()}
    if t.type == "pattern":
        low = t.pattern.lower() if t.case_insensitive else t.pattern
        return {(t.pattern, t.case_insensitive): Exists(t.pattern, t.case_insensitive) if policy.usable(t.pattern) else Exists(re.escape(low), t.case_insensitive)}
    if t.type == "context":
        return {(t.field, t.value): Distinct([f"{t.field}:{t.value}".lower()])}
    return {}


@dataclass
class EgressScan:
    """A pipeline's and its stop rules' matchers, and how their columns become a verdict."""

    scan: Scan
    bases: dict[int, dict[str, str]]
    pipeline: Pipeline
    stops: list[Trigger]
    flags: dict[tuple, str]

    def verdict(self, df: DataFrame) -> DataFrame:
        """``df`` (with the matchers' columns, which go) with ``stop``: whether an enabled stop rule holds."""
        results = {k: c.result(F.lit(None).cast("string"), False, {n: F.col(col) for n, col in self.bases[k].items()}).cast(C.RESULT) for k, c in self.pipeline.classifiers().items()}
        df = df.withColumn("_results", self.pipeline.results(results)).withColumn("_scores", score_map(F.col("_results")))
        holds = reduce(lambda a, b: a | b, [self.holds(t) for t in self.stops], F.lit(False))
        return df.withColumn("stop", holds).withColumn("final_score", final(F.col("_results"))["score"]).drop("_results", "_scores", *self.scan.matchers)

    def holds(self, t: Trigger) -> Column:
        if t.type == "composite":
            parts = [self.holds(x) for x in t.triggers]
            return reduce((lambda a, b: a & b) if t.operator == "and" else (lambda a, b: a | b), parts) if parts else F.lit(False)
        if t.type == "classifier":
            return F.coalesce(F.try_element_at("_scores", F.lit(t.classifier)) >= t.threshold, F.lit(False))
        key = (t.pattern, t.case_insensitive) if t.type == "pattern" else (t.field, t.value)
        return F.col(self.flags[key]) if t.type == "pattern" else F.col(self.flags[key]) > 0


def scan_for(pipeline: Pipeline | None, policies: list[Policy]) -> EgressScan:
    """What egress needs of a growing text. ValueError if a classifier or pattern can't be resumed."""
    pipeline = pipeline or Pipeline()
    matchers: dict[str, Matcher] = {}
    bases: dict[int, dict[str, str]] = {}
    for i, (k, c) in enumerate(pipeline.classifiers().items()):
        found = of_classifier(c)
        bases[k] = {n: f"_scan_{i}_{n}" for n in found}
        matchers |= {bases[k][n]: m for n, m in found.items()}
    stops = [r.trigger for p in policies for r in p.rules if r.enabled and any(a.type == "stop" for a in r.actions)]
    wanted = {k: m for t in stops for k, m in of_trigger(t).items()}
    flags = {k: f"_scan_rule_{i}" for i, k in enumerate(wanted)}
    matchers |= {flags[k]: m for k, m in wanted.items()}
    return EgressScan(Scan(matchers), bases, pipeline, stops, flags)


def scanned(df: DataFrame, scan: Scan, text: str = "chunk", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """``df`` with the matchers' columns for all of a stream's text up to each row, streams side by side.

    A stream's rows pass one task in order, a row at a time; only the state is held.
    """
    columns = df.columns
    schema = StructType([*df.schema.fields, *[StructField(n, StructType.fromDDL(f"x {m.kind}")["x"].dataType) for n, m in scan.matchers.items()]])
    types = to_arrow_schema(schema)
    at, key_at = columns.index(text), columns.index(stream)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), scan.start
        for batch in batches:
            values = []
            for k, chunk in zip(batch.column(key_at).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if k != key:
                    key, state = k, scan.start
                state, value = scan.step(state, chunk)
                values.append(value)
            new = list(zip(*values, strict=True)) or [() for _ in scan.matchers]
            made = [pa.array(v, types.field(n).type) for n, v in zip(scan.matchers, new, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], types.names)

    return df.repartition(stream).sortWithinPartitions(stream, seq).mapInArrow(run, schema)
