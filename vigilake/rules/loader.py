"""Evaluators from configurations: dictionaries, or YAML files and directories.

Rules that can't work (no pattern, no keywords, no detection, a pattern that the dialect refuses) are skipped with a
warning.  Of evaluators that share a name the last one counts, in the first one's place.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

import yaml

from vigilake.functions.regexes import UnsupportedPattern, lint, to_jvm
from vigilake.operators.rate_queries import recognise
from vigilake.operators.rates import RateSpec
from vigilake.rules.model import DEFAULT_ACTION, DEFAULT_STAGES, Evaluator, Pattern, Rule
from vigilake.schema import ACTIONS

log = logging.getLogger(__name__)
KNOWN_TYPES = ("regex", "pattern", "sigma", "cel", "sql")


def _action(raw: dict, kind: str) -> str:
    got = str(raw.get("action", "")).lower()
    return got if got in ACTIONS else DEFAULT_ACTION[kind]


def _patterns(raw: dict) -> tuple[Pattern, ...]:
    listed = raw["patterns"] if "patterns" in raw else [raw["pattern"]] if "pattern" in raw else []
    out = []
    for p in listed:
        p = {"pattern": p} if isinstance(p, str) else p
        try:
            out.append(Pattern(to_jvm(p["pattern"]), bool(p.get("negate", False)), p.get("field")))
        except UnsupportedPattern as e:
            log.warning("rule %s: %s; pattern skipped", raw.get("id"), e)
            continue
        for what in lint(p["pattern"]):
            log.info("rule %s: %s", raw.get("id"), what)
    return tuple(out)


def _told(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


def rule_from(raw: dict, kind: str, category: str = "") -> Rule | None:
    """The rule of a configuration entry, or None if it can't work."""
    title = raw.get("title") or raw.get("name") or raw.get("id")
    if not title:
        log.warning("a %s rule without a title is skipped", kind)
        return None
    base = {"id": str(raw.get("id") or title), "title": str(title), "action": _action(raw, kind), "description": raw.get("description", ""), "category": raw.get("category", category)}
    base |= {"priority": _told(raw.get("priority")), "status": _told(raw.get("status")), "logsource": _told(raw.get("logsource"))}
    if kind == "regex":
        patterns = _patterns(raw)
        fields = raw.get("fields", ())
        more = {"patterns": patterns, "match_all": raw.get("match") == "all", "fields": (fields,) if isinstance(fields, str) else tuple(fields)} if patterns else None
    elif kind == "pattern":
        words = tuple(map(str, raw.get("keywords") or ()))
        more = {"keywords": words, "case_sensitive": bool(raw.get("case_sensitive", False))} if words else None
    elif kind == "sigma":
        found = dict(raw.get("detection") or {})
        condition = str(found.pop("condition", "") or "")
        more = {"selections": found, "condition": condition} if found else None
    elif kind == "cel":
        text = raw.get("expr") or raw.get("expression")
        more = {"expr": text, "reason": raw.get("reason", "")} if text else None
    else:
        spec = raw.get("rate") or (recognise(raw["query"], raw["condition"]) if raw.get("query") and raw.get("condition") else None)
        more = {"rate": spec if isinstance(spec, RateSpec) else RateSpec(**spec), "reason": raw.get("reason", "")} if spec else None
    if more is None:
        log.warning("rule %s has nothing to match with; skipped", base["id"])
        return None
    return Rule(**base, **more)


def _files(place: str | None, root: Path) -> list[dict]:
    """Rules of a YAML file, or of all YAML files of a directory in the order of their paths; several documents a file."""
    if not place:
        return []
    path = Path(place) if Path(place).is_absolute() else root / place
    files = sorted([*path.glob("*.yaml"), *path.glob("*.yml")]) if path.is_dir() else [path]
    out = []
    for f in files:
        for doc in yaml.safe_load_all(f.read_text()):
            out += doc if isinstance(doc, list) else [doc] if doc else []
    return out


def evaluator_from(raw: dict, root: Path = Path("."), load_rules_files: bool = True) -> Evaluator | None:
    kind = raw.get("type")
    if not raw.get("enabled", True):
        return None
    if kind not in KNOWN_TYPES:
        log.warning("evaluator %s: unknown type %s; skipped", raw.get("name"), kind)
        return None
    listed = [*(raw.get("rules") or []), *_files(raw.get("rules_dir"), root), *(_files(raw.get("rules_file"), root) if load_rules_files else [])]
    rules = [r for r in (rule_from(x, kind, raw["name"]) for x in listed) if r]
    return Evaluator(raw["name"], kind, tuple(raw.get("stages") or DEFAULT_STAGES), tuple(rules))


def load(config: dict, root: str | Path = ".", load_rules_files: bool = True) -> list[Evaluator]:
    """Evaluators of a configuration, ``evaluators`` inline and in the files of ``evaluators_dir``."""
    root = Path(root)
    listed = [*(config.get("evaluators") or [])]
    if config.get("evaluators_dir"):
        listed += _files(config["evaluators_dir"], root)
    by_name: dict[str, dict] = {}
    for raw in listed:
        by_name[raw["name"]] = raw
    return [e for e in (evaluator_from(r, root, load_rules_files) for r in by_name.values()) if e]


def load_file(path: str | Path) -> list[Evaluator]:
    return load(yaml.safe_load(Path(path).read_text()), Path(path).parent)
