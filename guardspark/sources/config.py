"""YAML configuration: policies, classifier pipelines, models, tenants. Everything here runs on the driver."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

from guardspark.errors import ConfigError

log = logging.getLogger(__name__)
#: Largest configuration file that is read.
MAX_CONFIG_BYTES = 1_048_576
MODEL_SUFFIXES = (".safetensors", ".pt", ".pth", ".bin")
LEVELS = ("debug", "info", "warn", "error")
SEVERITIES = ("low", "medium", "high", "critical")
POSITIONS = ("before", "after", "replace")
PARAMETERS = ("temperature", "top_p", "top_k", "repetition_penalty")


@dataclass(frozen=True)
class Trigger:
    """One of pattern, classifier, context or composite."""

    type: str
    pattern: str = ""
    case_insensitive: bool = False
    classifier: str = ""
    threshold: float = 0.0
    field: str = ""
    value: str = ""
    operator: str = "and"
    triggers: tuple[Trigger, ...] = ()

    @classmethod
    def of(cls, d: dict) -> Trigger:
        kind = d.get("type")
        if kind == "composite":
            if d.get("operator") not in ("and", "or"):
                raise ConfigError(f"unknown operator {d.get('operator')}")
            return cls("composite", operator=d["operator"], triggers=tuple(map(cls.of, d["triggers"])))
        need = {"pattern": ("pattern",), "classifier": ("classifier", "threshold"), "context": ("field", "value")}.get(str(kind))
        if need is None:
            raise ConfigError(f"unknown trigger type {kind}")
        if missing := [k for k in need if k not in d]:
            raise ConfigError(f"trigger {kind} lacks {missing}")
        extra = {"case_insensitive": bool(d.get("case_insensitive", False))} if kind == "pattern" else {}
        return cls(str(kind), **{k: d[k] for k in need}, **extra)


@dataclass(frozen=True)
class Action:
    """One of log, stop, redact, inject, adapt or audit."""

    type: str
    message: str | None = None
    level: str = "info"
    status_code: int = 403
    replacement: str = "[REDACTED]"
    content: str = ""
    position: str = "after"
    parameter: str = ""
    value: float = 0.0
    category: str = ""
    severity: str = "low"

    @classmethod
    def of(cls, d: dict) -> Action:
        need = {"log": ("message",), "stop": (), "redact": (), "inject": ("content",), "adapt": ("parameter", "value"), "audit": ("category", "severity")}
        allowed = {"log": ("message", "level"), "stop": ("message", "status_code"), "redact": ("replacement",), "inject": ("content", "position"), "adapt": ("parameter", "value"), "audit": ("category", "severity")}
        kind = d.get("type")
        if kind not in need:
            raise ConfigError(f"unknown action type {kind}")
        if missing := [k for k in need[kind] if k not in d]:
            raise ConfigError(f"action {kind} lacks {missing}")
        out = cls(kind, **{k: d[k] for k in allowed[kind] if k in d})
        for value, values in ((out.level, LEVELS), (out.severity, SEVERITIES), (out.position, POSITIONS)):
            if value not in values:
                raise ConfigError(f"{value} is none of {values}")
        if kind == "adapt" and out.parameter not in PARAMETERS:
            raise ConfigError(f"unknown parameter {out.parameter}")
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    trigger: Trigger
    actions: tuple[Action, ...]
    description: str = ""
    regulation: str | None = None
    enabled: bool = True

    @classmethod
    def of(cls, d: dict) -> Rule:
        return cls(d["name"], Trigger.of(d["trigger"]), tuple(map(Action.of, d["actions"])), d.get("description") or "", d.get("regulation"), d.get("enabled", True))


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    description: str = ""
    version: str = ""
    regulation: str | None = None

    @classmethod
    def from_yaml(cls, text: str) -> Policy:
        try:
            d = yaml.safe_load(text)
            return cls(d["name"], tuple(map(Rule.of, d["rules"])), d.get("description") or "", str(d.get("version") or ""), d.get("regulation"))
        except (yaml.YAMLError, KeyError, TypeError, AttributeError) as e:
            raise ConfigError(f"not a policy: {e!r}") from e

    @classmethod
    def from_file(cls, path: str | Path) -> Policy:
        return cls.from_yaml(Path(path).read_text())


def load_policies(path: str | Path) -> list[Policy]:
    """A file, or every YAML file of a folder in name order (bad ones are logged and skipped); none if there is nothing."""
    path = Path(path)
    if path.is_file():
        return [Policy.from_file(path)]
    found = []
    for p in sorted(path.glob("*.y*ml")) if path.is_dir() else []:
        try:
            found.append(Policy.from_file(p))
        except ConfigError as e:
            log.warning("skipped %s: %s", p, e)
    return found


@dataclass
class ModelConfig:
    name: str
    source: dict = field(default_factory=dict)
    architecture: dict = field(default_factory=dict)
    revision: str = "main"
    device: str = "cpu"
    max_length: int = 512
    batch_size: int = 1
    threshold: float = 0.5
    pooling: str = "mean"
    quantization: str = "int8_dynamic"
    labels: list[str] = field(default_factory=list)

    @property
    def accelerator(self) -> tuple[str, int]:
        """Device and its number: ``cuda:1`` is (cuda, 1), ``cpu`` (cpu, 0)."""
        kind, _, number = self.device.partition(":")
        return kind, int(number or 0)

    def with_(self, **changes) -> ModelConfig:
        return replace(self, **changes)


@dataclass
class ClassifierConfig:
    models: dict[str, dict]
    pipelines: dict[str, dict]
    default_device: str = "cpu"
    default_quantize: bool = True
    models_dir: str = "./models"

    @classmethod
    def from_yaml(cls, text: str) -> ClassifierConfig:
        d = yaml.safe_load(text) or {}
        if not isinstance(d, dict):
            raise ConfigError("not a mapping")
        return cls(d.get("models") or {}, d.get("pipelines") or {}, d.get("default_device", "cpu"), d.get("default_quantize", True), d.get("models_dir", "./models"))

    @classmethod
    def from_file(cls, path: str | Path) -> ClassifierConfig:
        return cls.from_yaml(Path(path).read_text())

    def model_names(self) -> list[str]:
        return sorted(self.models)

    def pipeline_names(self) -> list[str]:
        return sorted(self.pipelines)


def load_models(text: str) -> dict[str, ModelConfig]:
    """The model registry: name to settings with defaults."""
    d = (yaml.safe_load(text) or {}).get("models") or {}
    out = {}
    for name, m in d.items():
        inference, output = m.get("inference") or {}, m.get("output") or {}
        source = m.get("source") or {}
        out[name] = ModelConfig(
            name, source, m.get("architecture") or {}, source.get("revision", "main"), inference.get("device", "cpu"), inference.get("max_length", 512),
            inference.get("batch_size", 1), inference.get("threshold", 0.5), (m.get("architecture") or {}).get("pooling", "mean"),
            inference.get("quantization", "int8_dynamic"), output.get("labels") or [],
        )
    return out


@dataclass
class TenantConfig:
    id: str
    backend_url: str | None = None
    policy_path: str | None = None
    stream_format: str | dict | None = None
    safety_threshold: float | None = None
    chunk_threshold: float | None = None
    api_keys: list[str] = field(default_factory=list)


@dataclass
class ServiceConfig:
    """Settings with their defaults."""

    backend_url: str = "https://api.openai.com/v1"
    policy_path: str = "./policies/default.yaml"
    stream_format: str | dict = "openai"
    safety_threshold: float = 0.7
    chunk_threshold: float = 0.8
    timeout_ms: int = 10
    token_holdback: int = 10
    max_buffer_capacity: int = 1000
    context_chunks: int = 5
    max_buffer_size: int = 100
    tenants: list[TenantConfig] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path, **overrides) -> ServiceConfig:
        """From a YAML file of at most 1 MB; defaults if it is missing; ``overrides`` win."""
        path = Path(path)
        d: dict = {}
        if path.exists():
            if path.stat().st_size > MAX_CONFIG_BYTES:
                raise ConfigError(f"{path} is larger than {MAX_CONFIG_BYTES} bytes")
            d = yaml.safe_load(path.read_text()) or {}
        names = cls.__dataclass_fields__
        found = {k: v for k, v in {**(d.get("default") or {}), **d}.items() if k in names and k != "tenants"}
        tenants = [TenantConfig(**{k: v for k, v in t.items() if k in TenantConfig.__dataclass_fields__}) for t in d.get("tenants") or []]
        return cls(**{**found, "tenants": tenants, **{k: v for k, v in overrides.items() if v is not None}})


@dataclass(frozen=True)
class AuditConfig:
    """Settings of the audit store with their defaults."""

    max_file_bytes: int = 100 * 1024 * 1024
    max_file_seconds: int = 86_400
    retention_days: int = 90
    flush_seconds: int = 10


@dataclass
class DemoConfig:
    """Settings of synthetic traffic: what is planted, for which share of requests."""

    requests_per_second: float = 1.0
    pii: float = 0.0
    toxicity: float = 0.0
    injection: float = 0.0
    financial: float = 0.0

    def with_(self, **changes: float) -> DemoConfig:
        out = replace(self, **changes)
        for kind in ("pii", "toxicity", "injection", "financial"):
            if not 0 <= getattr(out, kind) <= 1:
                raise ConfigError(f"{kind} is no share: {getattr(out, kind)}")
        return out


def discover_models(folder: str | Path) -> list[Path]:
    """Model files of a folder."""
    return sorted(p for p in Path(folder).glob("*") if p.suffix in MODEL_SUFFIXES)
