"""Validators made from settings and kept by name; a validator is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from millrace.functions.encode import ALGORITHMS
from millrace.functions.registry import Registry, Step
from millrace.operators import quality, validation
from millrace.operators.validation import FieldRule

# Algorithm of a checksum validator whose settings name none.
DEFAULT_ALGORITHM = "md5"

validators = Registry()


def from_settings(settings: Mapping) -> Step:
    """Validator of type ``schema``, ``checksum`` or ``quality``.

    * schema: ``rules`` maps a field to the settings of its ``FieldRule``; adds ``errors`` and ``valid``
    * checksum: ``column``, ``algorithm`` and, to compare, ``expected``
    * quality: ``columns``, ``group`` and thresholds in ``quality_rules``; one row per group with its verdict
    """
    kind = settings.get("type")
    if kind == "schema":
        if "rules" not in settings:
            raise ValueError("a schema validator needs rules")
        rules = [FieldRule(name, **rule) for name, rule in settings["rules"].items()]
        return lambda df: validation.validate(df, rules)
    if kind == "checksum":
        algorithm = settings.get("algorithm") or DEFAULT_ALGORITHM
        if algorithm.lower() not in ALGORITHMS:
            raise ValueError(f"unsupported checksum algorithm {algorithm!r}")
        return lambda df: validation.validate_checksum(df, settings["column"], algorithm, settings.get("expected"))
    if kind == "quality":
        thresholds = settings.get("quality_rules") or {}
        group = settings.get("group", ())
        return lambda df: quality.verdict(
            quality.scores(df, settings.get("columns") or [c for c in df.columns if c not in group], group), **thresholds
        )
    raise ValueError(f"unsupported validation type {kind!r}")


def create_and_register(name: str, settings: Mapping) -> Step:
    """Make a validator and keep it under its name."""
    return validators.register(name)(from_settings(settings))
