"""Errors by kind; the kind and the message are what a caller sees."""

from __future__ import annotations


class GuardError(Exception):
    kind, status = "internal", 500

    def __str__(self) -> str:
        return f"{self.kind} error: {super().__str__()}"


class PolicyError(GuardError):
    kind, status = "policy", 403


class ClassifierError(GuardError):
    kind, status = "classifier", 500


class StreamError(GuardError):
    kind, status = "stream", 502


class ConfigError(GuardError, ValueError):
    kind, status = "config", 400


class InternalError(GuardError):
    kind, status = "internal", 500
