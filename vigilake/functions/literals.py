"""What every match of a regular expression must hold: literals, digits side by side, a least length.

A text without them needs no matching.  Derived from the expression's parse tree; what can't be derived asks for nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 2  # literals shorter than that are in most texts


@dataclass(frozen=True)
class Needs:
    """One of ``literals`` (none named: any text), digits if ``digits``, ``length`` characters at least."""

    literals: frozenset[str] = frozenset()
    digits: bool = False
    length: int = 0
    any_case: bool = False

    @property
    def weight(self) -> int:
        return min(map(len, self.literals), default=0)


def _of_sequence(items) -> Needs:
    """The best of a sequence's parts; runs of plain characters are one literal."""
    found, run = [], []

    def end():
        if len(run) >= SHORTEST:
            found.append(Needs(frozenset({"".join(run)})))
        run.clear()

    for kind, value in items:
        if kind is kinds.LITERAL and value < 128:
            run.append(chr(value))
            continue
        end()
        if kind is kinds.SUBPATTERN:
            found.append(_of_sequence(value[-1]))
        elif kind is kinds.BRANCH:
            each = [_of_sequence(b) for b in value[1]]
            literals = frozenset().union(*(n.literals for n in each)) if all(n.literals for n in each) else frozenset()
            found.append(Needs(literals, all(n.digits for n in each)))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0]:
            inner = _of_sequence(value[2])
            found.append(Needs(inner.literals, inner.digits or (value[0] > 1 and list(value[2]) == [(kinds.IN, [(kinds.CATEGORY, kinds.CATEGORY_DIGIT)])])))
    end()
    return Needs(max(found, key=lambda n: n.weight, default=Needs()).literals, any(n.digits for n in found))


@lru_cache(maxsize=4096)
def needs(jvm_pattern: str) -> Needs:
    """Of a pattern in the JVM's dialect as rules hold it."""
    body = re.sub(r"(?<!\\)((?:\\\\)*)(\\z|\(\?<)", lambda m: m[1] + ("$" if m[2] == r"\z" else "(?P<"), jvm_pattern.removeprefix("(?Ud)"))
    try:
        tree = parser.parse(body)
    except (re.error, OverflowError):
        return Needs()
    # case can be switched inside: then all of it counts as switched
    any_case = bool(tree.state.flags & re.I) or bool(re.search(r"\(\?[a-z]*i", body))
    of = _of_sequence(tree)
    return Needs(frozenset(x.lower() for x in of.literals) if any_case else of.literals, of.digits, min(tree.getwidth()[0], 1 << 30), any_case)


def may_match(pattern: str, text: Column, of_event: bool) -> Column | None:
    """Whether ``text`` (of an event: its whole text, prepared) has what a match needs; None if nothing is known."""
    n, tests = needs(pattern), []
    if of_event and n.length > SHORTEST:
        tests.append(F.col("_len") >= n.length)
    if of_event and n.digits:
        tests.append(F.col("_digits"))
    if n.literals and (of_event or not n.any_case):
        on = F.col("_fold") if n.any_case else text
        some = None
        for x in sorted(n.literals):
            some = on.contains(x) if some is None else some | on.contains(x)
        tests.append(some)
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out
