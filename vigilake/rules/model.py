"""Rules as plain data, as loaded from rule files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

DEFAULT_STAGES = ("tool.before", "tool.after")
# Evaluators run in this order of types; equal ones as configured.
COST = {"regex": 0, "pattern": 1, "sigma": 2, "cel": 3, "sql": 4, "ml": 5, "llm": 6}
OTHER_COST = 99
# What a rule does if its file names no known action.
DEFAULT_ACTION = {"regex": "block", "pattern": "detect", "sigma": "detect", "cel": "block", "sql": "block"}


@dataclass(frozen=True)
class Pattern:
    regex: str  # in the JVM's dialect
    negate: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Rule:
    """One rule; which of the last fields count depends on its evaluator's type."""

    id: str
    title: str
    action: str
    description: str = ""
    category: str = ""
    # told in the catalogue, not matched with: priority, status, logsource as JSON
    priority: str | None = None
    status: str | None = None
    logsource: str | None = None
    # regex
    patterns: tuple[Pattern, ...] = ()
    match_all: bool = False
    fields: tuple[str, ...] = ()
    # pattern
    keywords: tuple[str, ...] = ()
    case_sensitive: bool = False
    # sigma: selection name -> mapping or list of mappings
    selections: dict = field(default_factory=dict, hash=False)
    condition: str = ""
    # cel
    expr: str = ""
    reason: str = ""
    # sql
    rate: object = None


@dataclass(frozen=True)
class Scorer:
    """A model over batches of texts.

    ``load`` makes it, once per Python worker; ``score`` (model, texts as a Series) gives a frame of action, reason and
    confidence, a row a text.  Both are sent to the workers.
    """

    load: Callable[[], object]
    score: Callable[[object, object], object]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Evaluator:
    name: str
    type: str
    stages: tuple[str, ...] = DEFAULT_STAGES
    rules: tuple[Rule, ...] = ()
    custom: object = None  # a function of no arguments that gives a result Column
    scorer: Scorer | None = None  # or a model that scores batches of texts

    @property
    def cost(self) -> int:
        return COST.get(self.type, OTHER_COST)


def in_order(evaluators: list[Evaluator]) -> list[Evaluator]:
    return sorted(evaluators, key=lambda e: e.cost)
