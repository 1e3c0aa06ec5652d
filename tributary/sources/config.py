"""Settings: rules, domains, critical paths and ignored files, from YAML."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: ** is anything, * and ? stay within a folder."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(kinds.get(p) or re.escape(p) for p in parts) + "$"


@dataclass
class Config:
    no_cycle: bool = True
    max_cross_domain: int = 2
    max_call_depth: int = 3
    forbid_core_entity_leakage: list[str] = field(default_factory=list)
    domains: dict[str, list[str]] = field(default_factory=dict)
    critical_paths: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)

    def prefixes(self) -> list[tuple[str, str]]:
        """(domain, prefix) pairs in order."""
        return [(d, p) for d, ps in self.domains.items() for p in ps]

    def visible(self, files: DataFrame) -> DataFrame:
        """files without those that an ignore pattern matches."""
        for pattern in self.ignore:
            files = files.where(~F.col("path").rlike(glob(pattern)))
        return files


def parse(text: str) -> Config:
    """The settings in a YAML text over the defaults; a text that isn't a mapping fails."""
    import yaml

    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("the settings must be a mapping")
    rules = raw.get("rules") or {}
    out = Config()
    for name in ("no_cycle", "max_cross_domain", "max_call_depth", "forbid_core_entity_leakage"):
        if name in rules:
            setattr(out, name, rules[name])
    out.domains = {str(k): [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in (raw.get("domains") or {}).items()}
    out.critical_paths = [str(x) for x in raw.get("critical_paths") or []]
    out.ignore = [str(x) for x in raw.get("ignore") or []]
    return out


def load(path: str) -> Config:
    """The settings of a file; the defaults if it isn't there."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
