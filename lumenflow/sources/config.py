"""Flat configuration: YAML if a parser is there, else the subset of it that flat files need."""

from __future__ import annotations

from pathlib import Path
from typing import Any


class Config(dict):
    """Keys are top-level names; get() takes dotted paths into nested mappings."""

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = dict.__getitem__(at, part)
        return at

    def data_dir(self, name: str) -> str:
        """data_dir.name; a missing one is a KeyError."""
        found = self.get(f"data_dir.{name}")
        if found is None:
            raise KeyError(f"data_dir.{name}")
        return str(found)


def _scalar(text: str) -> Any:
    text = text.split(" #")[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "'\"" and text[:1] == text[-1:]:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text in ("", "null", "~") else text


def parse(text: str) -> Config:
    """Mappings of scalars and one-line lists, nested by indentation."""
    root = Config()
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip() if raw.lstrip().startswith("#") else raw.rstrip()
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        name, _, value = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][name] = _scalar(value)
        else:
            stack[-1][1][name] = child = {}
            stack.append((indent, child))
    return root


def load(path: str | Path) -> Config:
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return parse(text)
    return Config(yaml.safe_load(text) or {})
