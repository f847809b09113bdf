"""Settings: a tree of defaults, overlaid by local ones and by the environment."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def overlay(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; where both have a mapping, the same again inside."""
    out = dict(base)
    for key, value in over.items():
        out[key] = overlay(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def flat(tree: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Leaves by dotted path."""
    out: dict[str, Any] = {}
    for key, value in tree.items():
        path = f"{prefix}{key}"
        out.update(flat(value, f"{path}.") if isinstance(value, Mapping) else {path: value})
    return out


def typed(text: str, like: Any) -> Any:
    """text as a value of like's type; as it is if that can't be."""
    try:
        if isinstance(like, bool):
            return text.strip().lower() in ("1", "true", "yes", "on")
        return type(like)(text) if isinstance(like, (int, float)) else text
    except ValueError:
        return text


def from_environment(tree: Mapping[str, Any], environment: Mapping[str, str], prefix: str = "") -> dict[str, Any]:
    """tree with leaves replaced by variables PREFIX_PATH_OF_KEYS."""
    out = overlay(tree, {})
    for path, value in flat(tree).items():
        name = f"{prefix}_{path}".strip("_").replace(".", "_").upper()
        if name in environment:
            node = out
            *above, last = path.split(".")
            for key in above:
                node[key] = dict(node[key])
                node = node[key]
            node[last] = typed(environment[name], value)
    return out
