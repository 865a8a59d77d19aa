"""Settings of a run: environment variables filled in, overrides laid over, and everything that is wrong said at once."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

TASKS = ("gec", "spam", "sentiment")
_VARIABLE = re.compile(r"\$\{(\w+)\}")


def expanded(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """${NAME} in any string of a nested value; empty if there is no such variable."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], ""), value)
    if isinstance(value, Mapping):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [expanded(v, env) for v in value]
    return value


def overridden(config: Mapping, overrides: Mapping[str, Any]) -> dict:
    """Keys like 'generator.model' replace nested values; those that are None change nothing."""
    found = {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    for name, value in overrides.items():
        if value is None:
            continue
        *path, last = name.split(".")
        at = found
        for key in path:
            at[key] = dict(at.get(key) or {})
            at = at[key]
        at[last] = value
    return found


def problems(config: Mapping) -> list[str]:
    """What is wrong, each with the path of the setting."""
    found = []
    if config.get("task") not in TASKS:
        found.append(f"task: {config.get('task')!r} is not one of {', '.join(TASKS)}")
    for name in ("num_runs", "sample_size"):
        value = config.get(name, 1)
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            found.append(f"{name}: {value!r} is not a whole number above 0")
    models = config.get("models", [])
    if not isinstance(models, list) or not models:
        found.append("models: there are none")
    else:
        found += [f"models[{i}].name: is missing" for i, m in enumerate(models) if not isinstance(m, Mapping) or not m.get("name")]
    mode = config.get("mode")
    if mode not in (None, "forward", "inverse"):
        found.append(f"mode: {mode!r} is neither forward nor inverse")
    if config.get("seedless") and not config.get("profile"):
        found.append("profile: seedless generation needs one")
    return found


def checked(config: Mapping) -> Mapping:
    if found := problems(config):
        raise ValueError("; ".join(found))
    return config


def provenance(config: Mapping, runs_completed: int, created: str, session: str) -> dict:
    """What a session's document says of its making; partial until all runs are done."""
    generator, judge, data = config.get("generator") or {}, config.get("judge") or {}, config.get("dataset") or {}
    return {
        "task": config["task"],
        "session": session,
        "created": created,
        "mode": config.get("mode"),
        "strategy": config.get("strategy"),
        "seedless": bool(config.get("seedless")),
        "provider": generator.get("provider"),
        "model": generator.get("model"),
        "judge_model": judge.get("model"),
        "dataset": data.get("name") or data.get("path"),
        "num_runs": config.get("num_runs", 1),
        "runs_completed": runs_completed,
        "sample_size": config.get("sample_size", 1),
        "partial": runs_completed < config.get("num_runs", 1),
        "models": [m["name"] for m in config.get("models", [])],
    }
