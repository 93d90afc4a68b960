"""Regular expressions of rules for the JVM: Unicode classes, line ends as written, no look-around."""

from __future__ import annotations

import re


class UnsupportedPattern(ValueError):
    """The pattern uses what a linear-time engine hasn't; its rule is skipped."""


_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}
_REFUSED = [
    (re.compile(r"\(\?(?:=|!|<=|<!)"), "look-around"),
    (re.compile(r"\(\?>"), "an atomic group"),
    (re.compile(r"(?<!\\)(?:\\\\)*\\[1-9]"), "a back-reference"),
    (re.compile(r"(?<!\\)[*+?}]\+"), "a possessive repeat"),
]
# Repeats of anything, twice over: slow where the engine backtracks.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[*+](?:[^()\\]|\\.)*\)[*+]")


def to_jvm(pattern: str) -> str:
    """The same language in the JVM's dialect, or UnsupportedPattern."""
    for found, what in _REFUSED:
        if found.search(pattern):
            raise UnsupportedPattern(f"{what} in {pattern!r}")
    out, in_class, i = [], False, 0
    multi = bool(re.match(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:]) if in_class else None
        if posix and posix[2] in _POSIX:
            out.append(f"\\{'P' if posix[1] else 'p'}{{{_POSIX[posix[2]]}}}")
            i += posix.end()
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            for extra in ("^", "]"):
                if pattern[i + 1 : i + 2] == extra:
                    out.append(extra if extra == "^" else "\\]")
                    i += 1
        elif c == "$" and not multi:
            out.append("\\z")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        else:
            out.append(c)
        i += 1
    jvm = "(?Ud)" + "".join(out)
    try:
        re.compile(pattern)
    except re.error as e:
        raise UnsupportedPattern(f"{pattern!r}: {e}") from e
    return jvm


def lint(pattern: str) -> list[str]:
    """What could make the pattern slow on long texts."""
    out = []
    if _NESTED.search(pattern):
        out.append("a repeat inside a repeat")
    if re.search(r"(?<!\\)\.[*+]", pattern):
        out.append("an unbounded run of any character")
    return out
