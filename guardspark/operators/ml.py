"""Model heads: pooling of token vectors, sigmoid and softmax results."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.errors import ClassifierError
from guardspark.functions.text import clamp
from guardspark.operators.classifiers import VectorClassifier


def mean_pool(vectors: DataFrame, key: str = "text_id", vec: str = "vec", mask: str = "mask") -> DataFrame:
    """key, dim, value: mean of the vectors with a mask above 0, of all of them if there is none. Partial sums before the shuffle."""
    rows = vectors.select(key, (F.col(mask) > 0).alias("on"), F.posexplode(F.col(vec)).alias("dim", "x"))
    masked = lambda f: f(F.when(F.col("on"), F.col("x").cast("double")))
    return rows.groupBy(key, "dim").agg(F.coalesce(masked(F.avg), F.avg(F.col("x").cast("double"))).alias("value"))


def pooled_in_row(vectors: Column, mask: Column) -> Column:
    """The same for arrays of vectors held in one row."""
    chosen = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: z["v"])
    use = F.when(F.size(chosen) > 0, chosen).otherwise(vectors)
    total = F.aggregate(use, F.transform(F.get(use, F.lit(0)), lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(use))


def sigmoid_score(vector: Column) -> Column:
    """sigmoid of the first component, clamped to [-8, 8]."""
    return 1 / (1 + F.exp(-clamp(F.coalesce(F.get(vector, F.lit(0)), F.lit(0.0)).cast("double"), -8.0, 8.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def sequence_result(probabilities: Column, labels: list[str], threshold: float) -> Column:
    """label, score: the last largest probability; with two labels the score is that of the second and the first wins up to the threshold."""
    best = F.array_max(F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    names = F.array(*map(F.lit, labels))
    predicted = F.coalesce(F.get(names, best["i"]), F.concat(F.lit("label_"), best["i"].cast("string")))
    if len(labels) == 2:
        score = F.coalesce(F.get(probabilities, F.lit(1)), best["p"])
        return F.struct(F.when(score <= threshold, labels[0]).otherwise(predicted).alias("label"), score.alias("score"))
    return F.struct(predicted.alias("label"), best["p"].alias("score"))


@dataclass(frozen=True)
class SequenceHead:
    """A sequence classifier's head in numpy: a linear layer over a text's vector and softmax. Weights are ``labels x dimensions``.

    A vector of another length counts as zeros where it ends early and is cut where it is longer; one that is null is zeros.
    """

    labels: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float = 0.5

    @classmethod
    def from_file(cls, path: str | Path, threshold: float = 0.5) -> SequenceHead:
        """From an ``.npz`` file with ``labels``, ``weights`` and ``bias``."""
        try:
            with np.load(path, allow_pickle=False) as f:
                out = cls(tuple(map(str, f["labels"])), f["weights"].astype(np.float64), f["bias"].astype(np.float64), threshold)
        except (OSError, KeyError, ValueError) as e:
            raise ClassifierError(f"not a head: {path}: {e!r}") from e
        if out.weights.ndim != 2 or out.weights.shape[0] != len(out.labels) or out.bias.shape != (len(out.labels),):
            raise ClassifierError(f"not a head: {path}: {out.weights.shape} weights for {len(out.labels)} labels")
        return out

    def probabilities(self, vectors: list) -> np.ndarray:
        x = np.zeros((len(vectors), self.weights.shape[1]))
        for row, v in zip(x, vectors, strict=True):
            if v is not None:
                n = min(len(v), len(row))
                row[:n] = v[:n]
        logits = x @ self.weights.T + self.bias
        powers = np.exp(logits - logits.max(1, keepdims=True))
        return powers / powers.sum(1, keepdims=True)

    def judge(self, vectors: pd.Series) -> pd.DataFrame:
        """label and score by vector, by the rules of :func:`sequence_result`."""
        p = self.probabilities(vectors.tolist())
        # The last of equal probabilities.
        best = p.shape[1] - 1 - p[:, ::-1].argmax(1)
        label, score = np.array(self.labels)[best], p[np.arange(len(p)), best]
        if len(self.labels) == 2:
            score = p[:, 1]
            label = np.where(score <= self.threshold, self.labels[0], label)
        return pd.DataFrame({"label": label, "score": score})


def head_classifier(name: str, head: SequenceHead) -> VectorClassifier:
    """A head as a classifier of a column of vectors. Its weights travel with the plan, as they are a few rows."""
    return VectorClassifier(name, lambda: head.judge, takes="vector")
