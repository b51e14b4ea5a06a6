"""Settings with strict overrides, error codes, device tiers, and the small languages of the command line."""
from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass, replace

#: Stable codes and HTTP statuses of failures (fixed values).
ERRORS = {"validation_error": 422, "unsupported_question_for_backend": 400, "image_load_failed": 400, "calibration_mismatch": 409, "backend_error": 500}


@dataclass(frozen=True)
class Limits:
    images: int = 4
    options: int = 128
    levels_min: int = 2
    levels_max: int = 10
    image_mb: int = 20


@dataclass(frozen=True)
class Evaluation:
    seed: int = 7
    bins: int = 15
    warm_up: int = 10
    baseline_n: int = 300
    permutations: int = 3
    failure_limit: float = 0.02
    top_errors: int = 20


@dataclass(frozen=True)
class Config:
    limits: Limits = field(default_factory=Limits)
    evaluation: Evaluation = field(default_factory=Evaluation)
    calibration_dir: str = "calibration"
    allow_hosted: bool = False


def override(config, patch: dict):
    """A config with values replaced at any depth; a name it does not have is an error."""
    known = {f.name for f in fields(config)}
    if unknown := set(patch) - known:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for name, value in patch.items():
        old = getattr(config, name)
        new[name] = override(old, value) if is_dataclass(old) else value
    return replace(config, **new)


def env_file(text: str, names: list[str]) -> dict[str, str]:
    """The allowed variables of a dotenv text, without quotes."""
    found = {}
    for line in text.splitlines():
        m = re.fullmatch(r"\s*(?:export\s+)?(\w+)\s*=\s*(.*?)\s*", line)
        if m and m[1] in names:
            found[m[1]] = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "'\"" else m[2]
    return found


def combine_spec(text: str) -> tuple[str, list[str], str]:
    """'name=k1+k2:mean' -> (name, keys, mode)."""
    m = re.fullmatch(r"(\w+)=([\w@]+(?:\+[\w@]+)*):(mean|concat)", text)
    if not m:
        raise ValueError(f"not name=key+key:mean|concat: {text}")
    return m[1], m[2].split("+"), m[3]


def tier(ram_gb: float, vram_gb: float = 0.0) -> str:
    """The model size a machine can hold."""
    room = max(vram_gb, ram_gb * 0.6)
    return "8b" if room >= 24 else "4b" if room >= 12 else "2b"


def trim_hours(seconds: dict[str, float], n: dict[str, int], most_hours: float) -> dict[str, int]:
    """Even item counts under one time cap for every suite, by bisection on the cap."""
    low, high = 0.0, max((seconds[s] * n[s] for s in n), default=0.0)

    def counts(cap: float) -> dict[str, int]:
        return {s: min(n[s], int(cap / seconds[s])) // 2 * 2 if seconds[s] > 0 else n[s] for s in n}

    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(seconds[s] * c for s, c in counts(mid).items()) <= most_hours * 3600 else (low, mid)
    return counts(low)
