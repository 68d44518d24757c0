"""Classifiers as Column expressions: text to ``struct<label, score, spans, model, all_scores, extra>``.

Every built-in stays inside JVM expressions. A classifier is anything with ``name``, ``tier`` and
``result(text) -> Column``; :class:`VectorClassifier` wraps a pandas function for models that need Python.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from types import ModuleType
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.functions import lexicons as L
from guardspark.functions import text as T

EXTRA = "array<struct<k:string,v:string>>"
SCORES = "array<struct<label:string,score:double>>"
RESULT = f"struct<label:string,score:double,spans:{T.SPAN},model:string,all_scores:{SCORES},extra:{EXTRA}>"


Base = dict[str, Column]


class Classifier(Protocol):
    name: str
    tier: str

    def base(self, text: Column) -> Base:
        """What several fields of the result need, by name."""
        ...

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        """``detail`` asks for spans, all scores and extras; label and score are always there. ``base`` as computed before, if so."""
        ...


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """At most so many rows of long texts or windows go to a Python worker, or come from it, at once; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def with_results(df: DataFrame, wanted: dict[str, Classifier], text: str, detail: bool = True) -> DataFrame:
    """``df`` with the result of each classifier under its name.

    Their bases are columns of a projection of their own, so each pattern is matched once a row however many fields and rules refer to it.
    """
    if any(isinstance(c, VectorClassifier) for c in wanted.values()):
        small_batches(df.sparkSession)
    bases = {into: {k: f"{into}_{k}" for k in c.base(F.col(text))} for into, c in wanted.items()}
    columns = {bases[into][k]: v for into, c in wanted.items() for k, v in c.base(F.col(text)).items()}
    df = df.withColumns(columns) if columns else df
    df = df.withColumns({into: c.result(F.col(text), detail, {k: F.col(n) for k, n in bases[into].items()}) for into, c in wanted.items()})
    return df.drop(*columns)


def result(label: Column, score: Column, spans: Column | None = None, model: Column | None = None, all_scores: Column | None = None, extra: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        label.cast("string").alias("label"), score.cast("double").alias("score"), (F.array() if spans is None else spans).cast(T.SPAN).alias("spans"),
        (none if model is None else model).cast("string").alias("model"), (none if all_scores is None else all_scores).cast(SCORES).alias("all_scores"),
        (F.array() if extra is None else extra).cast(EXTRA).alias("extra"),
    )


def pair(k: str, v: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))


def binary_scores(positive: Column, names: tuple[str, str] = ("negative", "positive")) -> Column:
    return F.array(F.struct(F.lit(names[0]).alias("label"), (1 - positive).alias("score")), F.struct(F.lit(names[1]).alias("label"), positive.alias("score")))


class Pattern:
    """Labelled literals, ASCII case-insensitive; the label is the first match's, the spans are all matches'."""

    def __init__(self, name: str, patterns: list[tuple[str, str]]):
        self.name, self.tier, self.patterns = name, "A", patterns
        self.regex = T.any_of([p for _, p in patterns])

    def base(self, text: Column) -> Base:
        return {"hit": F.when(T.maybe(text, [p for _, p in self.patterns]), F.lower(T.first(text, self.regex)))} if self.patterns else {}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        if not self.patterns:
            return result(F.lit("clean"), F.lit(0.0))
        hit = (base or self.base(text))["hit"]
        label = F.coalesce(*[F.when(hit == p.lower(), F.lit(name)) for name, p in self.patterns], F.lit("clean"))
        spans = F.when(hit.isNotNull(), T.all_spans(text, self.regex)).otherwise(F.array().cast(T.SPAN)) if detail else None
        return result(label, hit.isNotNull().cast("double"), spans)


class Pii:
    name, tier = "pii_detector", "A"

    def base(self, text: Column) -> Base:
        # An address needs its sign and a number its digits in their order: most texts are done after these.
        may = {k: text.contains("@") if k == "email" else text.rlike(r"\p{Nd}") & text.rlike(T.loose(p)) for k, p in L.PII}
        return {k: may[k] & text.rlike("(?U)" + p) for k, p in L.PII}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        hits = base or self.base(text)
        any_hit = reduce(lambda a, b: a | b, hits.values())
        label, score = F.when(any_hit, "pii_detected").otherwise("no_pii"), any_hit.cast("double")
        if not detail:
            return result(label, score)
        spans = F.array_compact(F.array(*[F.when(hits[k], T.first_span(text, "(?U)" + p)) for k, p in L.PII]))
        return result(label, score, spans, extra=F.array_compact(F.array(*[F.when(hits[k], pair("pii_type", F.lit(k))) for k, _ in L.PII])))


class Toxicity:
    name, tier = "toxicity", "B"

    def base(self, text: Column) -> Base:
        low = F.lower(text)
        return {"n": T.count_true([low.contains(w) for w in L.TOXIC])}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        score = T.clamp((base or self.base(text))["n"] * 0.35, 0.0, 0.95)
        return result(F.when(score > 0.5, "toxic").otherwise("safe"), score, model=F.lit("toxicity-lexicon"))


class Sentiment:
    tier = "A"

    def __init__(self, name: str = "sentiment"):
        self.name = name

    def base(self, text: Column) -> Base:
        return {k: T.count_any(text, w).cast("double") for k, w in (("pos", L.POSITIVE), ("neg", L.NEGATIVE))}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        base = base or self.base(text)
        pos, neg = base["pos"], base["neg"]
        score = F.when(pos + neg == 0, 0.5).otherwise(F.try_divide(pos, pos + neg))
        return result(F.when(score >= 0.5, "positive").otherwise("negative"), score, model=F.lit("sentiment-lexicon"), all_scores=binary_scores(score) if detail else None)


class Cascade:
    """Ordered categories; the first with a match gives label, score, spans and matched patterns."""

    tier = "A"

    def __init__(self, name: str, categories: list[tuple[str, float, str | None, list[str]]], default: tuple[str, float]):
        self.name, self.categories, self.default = name, categories, default

    def base(self, text: Column) -> Base:
        """Number of the first category with a match."""
        k = F.when(T.has_any(text, self.categories[0][3]), 0)
        for n, (_, _, _, terms) in enumerate(self.categories[1:], 1):
            k = k.when(T.has_any(text, terms), n)
        return {"k": k.otherwise(len(self.categories))}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        k = (base or self.base(text))["k"]
        label = F.get(F.array(*[F.lit(c[0]) for c in self.categories], F.lit(self.default[0])), k)
        score = F.get(F.array(*[F.lit(c[1]) for c in self.categories], F.lit(self.default[1])), k)
        if not detail:
            return result(label, score)
        spans, extra = F.when(k == -1, F.array().cast(T.SPAN)), F.when(k == -1, F.array().cast(EXTRA))
        for n, (name, _, reference, terms) in enumerate(self.categories):
            tail = [pair("category", F.lit(name))] + ([pair("fca_reference", F.lit(reference))] if reference else [])
            found = F.concat(F.transform(T.matches(text, T.any_of(terms)), lambda m: pair("matched_pattern", F.lower(m))), F.array(*tail))
            spans, extra = spans.when(k == n, T.all_spans(text, T.any_of(terms))), extra.when(k == n, found)
        return result(label, score, spans.otherwise(F.array().cast(T.SPAN)), extra=extra.otherwise(F.array(pair("category", F.lit(self.default[0])))))


def prompt_injection(name: str = "prompt-injection") -> Cascade:
    return Cascade(name, [(n, s, None, t) for n, s, t in L.INJECTION], ("clean", 0.0))


def financial_advice(name: str = "financial-advice") -> Cascade:
    return Cascade(name, L.ADVICE, ("information", 0.1))


def profanity() -> Pattern:
    return Pattern("profanity", [("profanity", w) for w in L.PROFANITY])


class Noop:
    tier = "A"

    def __init__(self, name: str):
        self.name = name

    def base(self, text: Column) -> Base:
        return {}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        return result(F.lit("clean"), F.lit(0.0))


def normalized_labels(n: int, labels: list[str]) -> list[str]:
    if labels:
        return list(labels)
    return {0: ["negative", "positive"], 1: ["positive"], 2: ["negative", "positive"]}.get(n, [f"label_{k}" for k in range(n)])


class Sequence:
    """Whole-word lexicon over ASCII-alphabetic tokens."""

    tier = "B"

    def __init__(self, name: str = "sequence", labels: list[str] | None = None, threshold: float = 0.5):
        self.name, self.labels, self.threshold = name, normalized_labels(2, labels or []), threshold

    def base(self, text: Column) -> Base:
        # As many as the words of a split at all other characters, without an array of them.
        word = lambda terms: f"(?i)(?<![A-Za-z])(?:{'|'.join(map(T.escape, terms))})(?![A-Za-z])"
        hits = lambda terms: F.when(text.isNotNull(), F.when(T.maybe(text, terms), F.regexp_count(text, F.lit(word(terms)))).otherwise(0)).cast("double")
        return {"pos": hits(L.SEQUENCE_POSITIVE), "neg": hits(L.SEQUENCE_NEGATIVE)}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        base = base or self.base(text)
        pos, neg = base["pos"], base["neg"]
        score = (
            F.when((pos == 0) & (neg == 0), 0.5)
            .when(neg == 0, T.clamp(0.92 + (pos - 1) * 0.03, 0.92, 0.99))
            .when(pos == 0, T.clamp(0.08 - (neg - 1) * 0.02, 0.01, 0.08))
            .otherwise(T.clamp(F.try_divide(pos, pos + neg), 0.1, 0.9))
        )
        names = self.labels
        high = names[1] if len(names) > 1 else names[0] if names else "positive"
        low = names[0] if len(names) > 1 else "negative"
        if len(names) == 1:
            scores = F.array(F.struct(F.lit(names[0]).alias("label"), score.alias("score")))
        else:
            scores = binary_scores(score, (low, high))
            if len(names) > 2:
                scores = F.concat(scores, F.array(*[F.struct(F.lit(n).alias("label"), F.lit(0.0).alias("score")) for n in names[2:]]))
        return result(F.when(score >= self.threshold, high).otherwise(low), score, model=F.lit(self.name), all_scores=scores)


class VectorClassifier:
    """A model in Python. ``load`` runs once a Python worker and gives the function of a series of texts to a frame with ``label`` and ``score``.

    ``takes`` is ``text`` (null is empty) or ``vector``: then the series has arrays of numbers, or None.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], tier: str = "C", takes: str = "text"):
        self.name, self.tier, self.load, self.takes = name, tier, load, takes

    def base(self, text: Column) -> Base:
        load, held, of_text = self.load, uuid.uuid4().hex, self.takes == "text"

        @F.pandas_udf("label string, score double")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            # Workers are used again by later tasks: a model stays with its worker.
            models = sys.modules.setdefault("_guardspark_models", ModuleType("_guardspark_models")).__dict__
            if held not in models:
                models[held] = load()
            for texts in batches:
                yield models[held](texts.fillna("") if of_text else texts)[["label", "score"]]

        return {"r": call(text)}

    def result(self, text: Column, detail: bool = True, base: Base | None = None) -> Column:
        r = (base or self.base(text))["r"]
        return result(r["label"], r["score"], model=F.lit(self.name))


def exceeds(r: Column, threshold: float) -> Column:
    return r["score"] >= threshold


def built_in() -> dict[str, Classifier]:
    """Every name that configurations may use without a model."""
    tox, pii, sent, inj, adv = Toxicity(), Pii(), Sentiment(), prompt_injection(), financial_advice()
    return {
        "pii": pii, "pii_detector": pii, "toxicity": tox, "toxicity-distilled": tox, "toxicity-gpu": tox, "toxicity-metal": tox,
        "sentiment": sent, "prompt-injection": inj, "financial-advice": adv, "profanity": profanity(), "readability": Noop("readability"),
    }
