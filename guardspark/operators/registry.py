"""Where classifiers come from: built-in ones, and models that a loader makes when they are first asked for.

Everything here runs on the driver. A loader returns something with ``base`` and ``result``; a model in Python is a
:class:`~guardspark.operators.classifiers.VectorClassifier`, whose weights are read once in each Python worker.
"""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

from guardspark.errors import ClassifierError
from guardspark.sources.config import ModelConfig, load_models

from .classifiers import Classifier, Sentiment, Sequence, built_in, normalized_labels

# Architectures that the lexicon stands in for while no weights are at hand.
SEQUENCE_FAMILIES = [
    "bert-sequence-classification", "distil-bert-sequence-classification", "roberta-sequence-classification", "xlm-roberta-sequence-classification",
    "mini-lm-sequence-classification", "deberta-sequence-classification",
]
# Parts of repository names that count as missing when nothing can be fetched.
MISSING_REPOSITORIES = ("does-not-exist", "nonexistent")
LEXICON_SENTIMENT = "lexicon_sentiment"


class Loader(Protocol):
    """A source of classifiers by name."""

    def load(self, name: str) -> Classifier: ...

    def available(self) -> list[str]: ...


def check_source(model: ModelConfig) -> None:
    """Raise where a model's source can't be right; nothing is fetched."""
    kind, source = model.source.get("type"), model.source
    if kind == "local" and not Path(source["path"]).exists():
        raise ClassifierError(f"model path does not exist: {source['path']}")
    if kind == "huggingface" and any(x in source.get("repo", "") for x in MISSING_REPOSITORIES):
        raise ClassifierError(f"repository not found: {source['repo']}")


class ModelLoader:
    """Classifiers of a model registry's settings, by architecture."""

    def __init__(self, models: dict[str, ModelConfig]):
        self.models = models

    @classmethod
    def from_yaml(cls, text: str) -> ModelLoader:
        return cls(load_models(text))

    @classmethod
    def from_file(cls, path: str | Path) -> ModelLoader:
        return cls.from_yaml(Path(path).read_text())

    def available(self) -> list[str]:
        return sorted(self.models)

    def load(self, name: str) -> Classifier:
        if name not in self.models:
            raise ClassifierError(f"model '{name}' is not in the registry")
        model = self.models[name]
        kind, shown = model.architecture.get("type"), model.name or name
        if kind == "custom":
            if model.architecture.get("implementation") != LEXICON_SENTIMENT:
                raise ClassifierError(f"custom architecture '{model.architecture.get('implementation')}' needs code")
            return Sentiment(shown)
        check_source(model)
        if kind == "sentence-transformer":
            return Sequence(shown, ["negative", "positive"], model.threshold)
        if kind in SEQUENCE_FAMILIES:
            labels = model.architecture.get("labels") or model.labels
            return Sequence(shown, normalized_labels(model.architecture.get("num_labels", 0), labels), model.threshold)
        raise ClassifierError(f"unknown architecture '{kind}'")


class Registry(dict):
    """Classifiers by name. A name that isn't there is loaded on first use and kept; without a loader it is an error."""

    def __init__(self, loader: Loader | None = None, known: dict[str, Classifier] | None = None, preload: tuple[str, ...] = ()):
        super().__init__(built_in() if known is None else known)
        self.loader = loader
        self.preload(*preload)

    def __missing__(self, name: str) -> Classifier:
        if self.loader is None:
            raise ClassifierError(f"classifier '{name}' is not known")
        self[name] = self.loader.load(name)
        return self[name]

    def preload(self, *names: str) -> None:
        for name in names:
            self[name]

    def available(self) -> list[str]:
        return self.loader.available() if self.loader else []


def referenced(pipelines: dict[str, dict]) -> list[str]:
    """Names of all classifiers that pipelines' stages mention."""
    stages = [s for p in pipelines.values() for s in p["stages"]]
    return sorted({k for s in stages for k in (s.get("classifiers") or [s["classifier"]])})


def device_problem(source: str, device: str) -> str | None:
    """Why the placeholder loader refuses a model: it takes local files on the processor."""
    if source == "huggingface":
        return "config error: models are not fetched"
    if device.startswith(("cuda", "metal")):
        return f"classifier error: {device.split(':')[0]} is not available"
    return None
