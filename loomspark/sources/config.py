"""Settings: texts of environment files, profiles from candidate places, and what overrides what."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping

from ..functions import patterns as P
from ..operators import quality as Q


def env_pairs(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and lines without = are left out, quotes around values are dropped."""
    lines = (x.strip() for x in text.splitlines())
    pairs = (x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs if k.strip()}


def with_defaults(present: Mapping[str, str], found: Mapping[str, str]) -> dict[str, str]:
    """What is already set stays; the rest is taken from what was found."""
    return {**found, **present}


def first_profile(paths: Iterable[str]) -> tuple[str, dict] | None:
    """The first of several files that holds a valid profile, with its path; files that are missing, broken or invalid are passed over."""
    for path in paths:
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8") as f:
                    profile = json.load(f)
            except ValueError:
                continue
            if isinstance(profile, dict) and not Q.profile_problems(profile):
                return path, profile
    return None


def merged(legacy: dict, profile: dict | None) -> dict:
    """Settings of a run: a profile's threshold, policy and expected costs before those of the older configuration, then defaults."""
    newer, expected = profile or {}, lambda d, k: {c: float(v) for c, v in (d.get(k) or {}).items()}
    policy = newer.get("categoryPolicy") or legacy.get("categoryPolicy") or {}
    threshold = next((x for x in (newer.get("threshold"), legacy.get("threshold")) if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= P.ROUTE_NONE), 0.5)
    return {
        "threshold": float(threshold), "always_escalate": sorted(policy.get("always_escalate", [])), "trust_local": sorted(policy.get("trust_local", [])),
        "expected_tokens": expected(newer, "expectedCompletionTokens") or expected(legacy, "expectedCompletionTokens"),
        "expected_latency": expected(newer, "expectedLocalLatencySeconds") or expected(legacy, "expectedLocalLatencySeconds"),
    }


def normalized_weights(profile: dict) -> dict[int, float]:
    """Weights by number; a place out of range or a value that is no finite number is an error."""
    out = {}
    for k, v in profile["weights"].items():
        i = int(k)
        if not 0 <= i < profile["dimension"] or isinstance(v, bool) or not isinstance(v, (int, float)) or abs(v) == float("inf") or v != v:
            raise ValueError(f"weight {k!r}")
        out[i] = float(v)
    return out
