"""Classifier pipelines as Column expressions: stages, conditions and aggregations over an array of results.

A pipeline compiles on the driver to one projection. :meth:`Pipeline.run` first computes each
distinct classifier once as a struct column and lets the stages refer to it, so a classifier that two
stages use is evaluated once a row.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.errors import ClassifierError

from .classifiers import RESULT, Classifier, Noop, VectorClassifier, built_in, with_results

log = logging.getLogger(__name__)

ITEM = f"struct<stage:string,classifier:string,result:{RESULT}>"
Condition = Callable[[Column], Column]
Transform = Callable[[Column], Column]


def item(stage: str, classifier: str, result: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(classifier).alias("classifier"), result.cast(RESULT).alias("result")).cast(ITEM)


def scored(results: Column, best: str) -> Column:
    """Score and place of the largest score (the last on ties) or the smallest (the first on ties)."""
    keyed = F.transform(results, lambda x, i: F.struct(x["result"]["score"].alias("score"), i.alias("i")))
    return (F.array_max if best == "max" else F.array_min)(keyed)


def agg_all(results: Column) -> Column:
    return results


def agg_max(results: Column) -> Column:
    return F.when(F.size(results) == 0, results).otherwise(F.array(F.get(results, scored(results, "max")["i"])))


def agg_min(results: Column) -> Column:
    return F.when(F.size(results) == 0, results).otherwise(F.array(F.get(results, scored(results, "min")["i"])))


def agg_first_positive(threshold: float) -> Callable[[Column], Column]:
    def run(results: Column) -> Column:
        high = F.filter(results, lambda x: x["result"]["score"] >= threshold)
        return F.when(F.size(high) > 0, F.array(F.get(high, F.lit(0)))).otherwise(results)

    return run


def agg_unanimous(results: Column) -> Column:
    """Keeps all results; see :func:`is_unanimous` for the agreement itself."""
    return results


def is_unanimous(results: Column, threshold: float = 0.5) -> Column:
    high = lambda x: x["result"]["score"] >= threshold
    return F.forall(results, high) | F.forall(results, lambda x: ~high(x))


def agg_weighted(results: Column) -> Column:
    """Unweighted mean in the place of the first result, which keeps its name and metadata."""
    mean = F.try_divide(F.aggregate(results, F.lit(0.0), lambda a, x: a + x["result"]["score"]), F.size(results).cast("double"))
    first = F.get(results, F.lit(0))
    label = F.when(mean >= 0.5, "positive").otherwise("negative")
    merged = first.withField("result", first["result"].withField("score", mean).withField("label", label))
    return F.when(F.size(results) == 0, results).otherwise(F.array(merged))


def aggregation(spec: str | dict | None) -> Callable[[Column], Column]:
    if isinstance(spec, dict):
        (name, options), = spec.items()
        if name == "first_positive":
            return agg_first_positive(float(options["threshold"]))
        spec = name
    return {None: agg_all, "all": agg_all, "max_score": agg_max, "min_score": agg_min, "unanimous": agg_unanimous, "weighted_average": agg_weighted}[spec]


def always() -> Condition:
    return lambda results: F.lit(True)


def any_above(threshold: float) -> Condition:
    return lambda results: F.exists(results, lambda x: x["result"]["score"] > threshold)


def all_above(threshold: float) -> Condition:
    return lambda results: (F.size(results) > 0) & F.forall(results, lambda x: x["result"]["score"] > threshold)


def triggered(classifier: str) -> Condition:
    return lambda results: F.exists(results, lambda x: (x["classifier"] == classifier) & (x["result"]["score"] > 0.5))


def condition(spec: str | dict | None) -> Condition:
    if spec in (None, "always"):
        return always()
    assert isinstance(spec, dict)
    (name, options), = spec.items()
    if name == "any_above_threshold":
        return any_above(float(options["threshold"]))
    if name == "all_above_threshold":
        return all_above(float(options["threshold"]))
    if name == "classifier_triggered":
        return triggered(options["classifier"])
    if name == "always":
        return always()
    raise ValueError(f"unknown condition {name}")


def normalized(low: float, high: float) -> Transform:
    """Scores from ``low`` to ``high`` to 0 to 1; what lies outside is 0 or 1."""
    if not low < high:
        raise ValueError(f"{low} isn't below {high}")
    return lambda score: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))


def transform(spec: dict | None) -> Transform | None:
    if spec is None:
        return None
    if spec.get("type") != "normalize":
        raise ValueError(f"unknown transform {spec.get('type')}")
    return normalized(float(spec.get("min", 0)), float(spec.get("max", 1)))


@dataclass
class Stage:
    kind: str
    name: str
    #: (configured name, classifier)
    classifiers: list[tuple[str, Classifier]]
    aggregate: Callable[[Column], Column] = agg_all
    when: Condition = field(default_factory=always)
    #: ``match``, ``threshold`` or ``never``: what of its results ends the pipeline for a row.
    exit_on: str = "never"
    threshold: float = 0.0
    #: What a score becomes before anything looks at it.
    transform: Transform | None = None

    def exits(self, found: Column) -> Column:
        """Whether this stage's results end the pipeline: a score above 0, or above the threshold. No score (of no text) never does."""
        least = {"match": 0.0, "threshold": self.threshold}[self.exit_on]
        return F.coalesce(F.exists(found, lambda x: x["result"]["score"] > least), F.lit(False))

    @property
    def in_python(self) -> bool:
        return any(isinstance(c, VectorClassifier) for _, c in self.classifiers)

    def transformed(self, result: Column) -> Column:
        return result if self.transform is None else result.withField("score", self.transform(result["score"]))

    def results(self, columns: dict[int, Column], prior: Column) -> Column:
        """This stage's results. Single and conditional stages name the classifier itself, the others the configured name."""
        by_own = self.kind in ("single", "conditional")
        found = F.array(*[item(self.name, c.name if by_own else key, self.transformed(columns[id(c)])) for key, c in self.classifiers]).cast(f"array<{ITEM}>")
        if self.kind == "parallel":
            found = self.aggregate(found)
        if self.kind == "conditional":
            found = F.when(self.when(prior), found).otherwise(F.array().cast(f"array<{ITEM}>"))
        return found


class Pipeline:
    """Fluent builder and compiler; ``results`` is an array of ITEM, ``final`` the last of them."""

    def __init__(self, name: str = "pipeline"):
        self.name, self.stages = name, []

    def single(self, name: str, classifier: Classifier) -> Pipeline:
        return self._add(Stage("single", name, [(classifier.name, classifier)]))

    def parallel(self, name: str, classifiers: list[tuple[str, Classifier]], aggregate: Callable[[Column], Column] = agg_all) -> Pipeline:
        return self._add(Stage("parallel", name, classifiers, aggregate))

    def sequential(self, name: str, classifiers: list[tuple[str, Classifier]]) -> Pipeline:
        return self._add(Stage("sequential", name, classifiers))

    def conditional(self, name: str, classifier: Classifier, when: Condition) -> Pipeline:
        return self._add(Stage("conditional", name, [(classifier.name, classifier)], when=when))

    def exiting(self, on: str, threshold: float = 0.0) -> Pipeline:
        """The last stage ends the pipeline for rows that match (a score above 0) or pass a threshold."""
        if on not in ("match", "threshold", "never"):
            raise ValueError(f"unknown exit {on}")
        self.stages[-1].exit_on, self.stages[-1].threshold = on, threshold
        return self

    def transforming(self, how: Transform | None) -> Pipeline:
        """The last stage's scores are transformed."""
        self.stages[-1].transform = how
        return self

    def _add(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    @property
    def stage_count(self) -> int:
        return len(self.stages)

    def classifiers(self, stages: list[Stage] | None = None) -> dict[int, Classifier]:
        return {id(c): c for s in (self.stages if stages is None else stages) for _, c in s.classifiers}

    def results(self, columns: dict[int, Column]) -> Column:
        so_far = F.array().cast(f"array<{ITEM}>")
        for stage in self.stages:
            so_far = F.concat(so_far, stage.results(columns, so_far))
        return so_far

    def run(self, df: DataFrame, text: str = "text", into: str = "results", detail: bool = False) -> DataFrame:
        """``df`` with the results array; classifier columns are temporary. Spans and extras only if ``detail`` asks for them.

        A row that a stage lets out gets no results of later stages. It leaves before the next stage that runs in Python (a
        :class:`VectorClassifier`), so the model never sees it; the rows that left are united with the others again. The stages before are
        JVM expressions, which both sides compute for themselves: a second look at a text costs less than a shuffle of all texts.
        """
        if not any(s.exit_on != "never" for s in self.stages):
            df, columns = self.classified(df, self.stages, text, detail)
            return df.withColumn(into, self.results({k: F.col(n) for k, n in columns.items()})).drop(*columns.values())
        df = self.routed(df.withColumns({"_results": F.array().cast(f"array<{ITEM}>"), "_left": F.lit(False)}), self.stages, text, detail)
        return df.withColumn(into, F.col("_results")).drop("_results", "_left")

    def classified(self, df: DataFrame, stages: list[Stage], text: str, detail: bool) -> tuple[DataFrame, dict[int, str]]:
        names = {key: f"_clf_{k}" for k, key in enumerate(self.classifiers(stages))}
        return (with_results(df, {names[key]: c for key, c in self.classifiers(stages).items()}, text, detail) if names else df), names

    def routed(self, df: DataFrame, stages: list[Stage], text: str, detail: bool) -> DataFrame:
        """``df`` with ``_results`` so far and ``_left`` (whether the row has left) after ``stages``."""
        first = next((k for k, s in enumerate(stages) if s.in_python and any(b.exit_on != "never" for b in stages[:k])), len(stages))
        now, later = stages[:first], stages[first:]
        df, columns = self.classified(df, now, text, detail)
        # A projection a stage: what a stage finds, and whether the row has left by then, is asked for by all that come after it.
        for stage in now:
            found = stage.results({k: F.col(n) for k, n in columns.items()}, F.col("_results"))
            df = df.withColumn("_found", F.when(F.col("_left"), F.array().cast(f"array<{ITEM}>")).otherwise(found))
            left = F.col("_left") if stage.exit_on == "never" else F.col("_left") | stage.exits(F.col("_found"))
            df = df.withColumns({"_results": F.concat("_results", "_found"), "_left": left}).drop("_found")
        df = df.drop(*columns.values())
        if not later:
            return df
        # A filter is pushed below projections with all that its column is made of, but not below a generator (an outer one, from which Spark infers no filter).
        rest = [c for c in df.columns if c not in ("_results", "_left")]
        df = df.select(*rest, F.explode_outer(F.array(F.struct("_results", "_left"))).alias("_s")).select(*rest, "_s._results", "_s._left")
        return df.where("_left").unionByName(self.routed(df.where("not _left"), later, text, detail))


def run_all(df: DataFrame, wanted: dict[str, Pipeline], text: str = "text", detail: bool = False) -> DataFrame:
    """``df`` with the results of several pipelines. A classifier that more than one of them has is computed once a row."""
    plain = {into: p for into, p in wanted.items() if all(s.exit_on == "never" for s in p.stages)}
    together = Pipeline()
    df, columns = together.classified(df, [s for p in plain.values() for s in p.stages], text, detail)
    found = {k: F.col(n) for k, n in columns.items()}
    df = df.withColumns({into: p.results(found) for into, p in plain.items()}).drop(*columns.values()) if plain else df
    for into, p in wanted.items():
        df = df if into in plain else p.run(df, text, into, detail)
    return df


def final(results: Column) -> Column:
    """The last result whatever the aggregation; null if there is none."""
    return F.try_element_at(results, F.lit(-1))["result"]


def score_map(results: Column) -> Column:
    """Scores by classifier name, later ones winning, with ``_final``."""
    entries = F.transform(results, lambda x: F.struct(x["classifier"].alias("key"), x["result"]["score"].alias("value")))
    entries = F.when(F.size(results) > 0, F.concat(entries, F.array(F.struct(F.lit("_final").alias("key"), final(results)["score"].alias("value"))))).otherwise(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def from_config(name: str, spec: dict, registry: dict[str, Classifier] | None = None, strict: bool = False) -> Pipeline:
    """A pipeline from its YAML mapping. Classifiers that the registry can't give are no-ops, or errors if ``strict``."""
    known = built_in() if registry is None else registry

    def find(key: str) -> Classifier:
        try:
            return known[key]
        except (KeyError, ClassifierError) as e:
            if strict:
                raise ClassifierError(f"pipeline '{name}' needs classifier '{key}': {e}") from e
            log.warning("pipeline %s: no classifier %s, it will find nothing", name, key)
            known[key] = Noop(key)
            return known[key]

    out = Pipeline(name)
    for s in spec["stages"]:
        kind = s["type"]
        if kind == "single":
            out.single(s["name"], find(s["classifier"]))
        elif kind == "conditional":
            out.conditional(s["name"], find(s["classifier"]), condition(s.get("condition")))
        elif kind == "parallel":
            out.parallel(s["name"], [(k, find(k)) for k in s["classifiers"]], aggregation(s.get("aggregation")))
        elif kind == "sequential":
            out.sequential(s["name"], [(k, find(k)) for k in s["classifiers"]])
        else:
            raise ValueError(f"unknown stage type {kind}")
        out.exiting(s.get("exit_on", "never"), float(s.get("threshold", 0))).transforming(transform(s.get("transform")))
    return out
