"""Policy sets that extend one another: rules with mode, priority and "continue", and their resolution to one ordered list. Runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

import yaml

from guardspark.errors import ConfigError
from guardspark.sources.config import Action, Rule, Trigger

MODES = ("enforce", "shadow", "disabled")
PHASES = ("ingress", "midstream", "egress", "all")


@dataclass(frozen=True)
class RankedRule:
    """A rule of a set. ``goes_on``: whether lower rules are looked at once it has fired."""

    rule: Rule
    policy: str
    mode: str = "enforce"
    priority: int = 50
    phase: str = "all"
    goes_on: bool = False

    @classmethod
    def of(cls, d: dict, policy: str, defaults: dict) -> RankedRule:
        try:
            actions = d["actions"] if "actions" in d else [d["action"]]
            actions = [{"type": a} if isinstance(a, str) else a for a in actions]
            actions = [{"message": d["message"], **a} if a["type"] == "stop" and d.get("message") else a for a in actions]
            rule = Rule(d["name"], Trigger.of(d["trigger"]), tuple(map(Action.of, actions)), d.get("description") or "", d.get("regulation"))
        except (KeyError, TypeError) as e:
            raise ConfigError(f"not a rule of {policy}: {e!r}") from e
        said = {k: d.get(k, defaults.get(k)) for k in ("mode", "priority", "phase", "continue")}
        out = cls(rule, policy, said["mode"] or "enforce", 50 if said["priority"] is None else int(said["priority"]), said["phase"] or "all", bool(said["continue"]))
        if out.mode not in MODES or out.phase not in PHASES or not 0 <= out.priority <= 100:
            raise ConfigError(f"rule {out.rule.name}: mode {out.mode}, phase {out.phase}, priority {out.priority}")
        return out


@dataclass(frozen=True)
class PolicySet:
    name: str
    rules: tuple[RankedRule, ...]
    extends: tuple[str, ...] = ()

    @classmethod
    def from_yaml(cls, text: str) -> PolicySet:
        try:
            d = yaml.safe_load(text)
            bases = d.get("extends") or []
            rules = tuple(RankedRule.of(r, d["name"], d.get("defaults") or {}) for r in d.get("policies") or [])
            return cls(d["name"], rules, tuple([bases] if isinstance(bases, str) else bases))
        except (yaml.YAMLError, KeyError, TypeError, AttributeError) as e:
            raise ConfigError(f"not a policy set: {e!r}") from e


def resolve(name: str, sets: dict[str, PolicySet]) -> list[RankedRule]:
    """All rules of a set in the order in which they are looked at: highest priority first, then those of bases before own ones, as declared.

    A rule replaces the one of the same name that it inherits, in its place. Sets that are inherited by several ways count once. A set that
    extends itself, by whatever way, and a base that isn't there are errors.
    """
    found: dict[str, RankedRule] = {}
    done: set[str] = set()

    def visit(at: str, way: tuple[str, ...]) -> None:
        if at in way:
            raise ConfigError(f"{' extends '.join([*way[way.index(at) :], at])}")
        if at not in sets:
            raise ConfigError(f"{way[-1] if way else 'nothing'} extends {at}, which isn't there")
        if at in done:
            return
        for base in sets[at].extends:
            visit(base, (*way, at))
        done.add(at)
        found.update({r.rule.name: r for r in sets[at].rules})

    visit(name, ())
    return sorted(found.values(), key=lambda r: -r.priority)


def load_sets(path: str | Path) -> dict[str, PolicySet]:
    """The sets of a folder's YAML files by file name; ``extends`` names files beside the file itself."""
    out = {}
    for p in sorted(Path(path).glob("*.y*ml")):
        s = PolicySet.from_yaml(p.read_text())
        out[p.name] = replace(s, extends=tuple(Path(e).name for e in s.extends))
    return out
