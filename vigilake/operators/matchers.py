"""Rules as boolean columns over prepared events: regular expressions, keywords, Sigma selections, CEL predicates."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.fields import activation, field
from vigilake.functions.literals import may_match
from vigilake.functions.regexes import UnsupportedPattern, to_jvm
from vigilake.rules.model import Rule

MASK = "[REDACTED]"
PREVIEW = 200


def _all(cols: list[Column]) -> Column:
    return reduce(and_, cols) if cols else F.lit(False)


def _some(cols: list[Column]) -> Column:
    return reduce(or_, cols) if cols else F.lit(False)


# --- regular expressions -----------------------------------------------------------------------------------


def _found(on: Column, regex: str, of_event: bool = False) -> Column:
    """A match of a rule's expression, tried only where the text has what a match needs."""
    may = may_match(regex, on, of_event)
    return on.rlike(regex) if may is None else may & on.rlike(regex)


def _hit_on(rule: Rule, target: Column) -> Column:
    tests = []
    for p in rule.patterns:
        on = F.coalesce(field(p.field), F.lit("")) if p.field else target
        found = _found(on, p.regex, not p.field and not rule.fields)
        tests.append(~found if p.negate else found)
    return (_all if rule.match_all else _some)(tests)


def _evidence(rule: Rule, target: Column) -> Column:
    """The first match of the first pattern that isn't negated and matches, cut to a preview."""
    each = [F.regexp_substr(F.coalesce(field(p.field), F.lit("")) if p.field else target, F.lit(p.regex)) for p in rule.patterns if not p.negate]
    return F.left(F.coalesce(*each, F.lit("")), F.lit(PREVIEW))


def redact_text(text: Column, rule: Rule) -> Column:
    """``text`` with all matches of the rule's patterns masked."""
    for p in rule.patterns:
        if not p.negate:
            text = F.regexp_replace(text, p.regex, re.sub(r"([\\$])", r"\\\1", MASK))
    return text


def _on_targets(rule: Rule) -> list[tuple[Column, Column]]:
    """(target, hit) of each field of a regex rule, or of the whole text."""
    if not rule.fields:
        return [(F.col("_text"), _hit_on(rule, F.col("_text")))]
    return [(t, F.coalesce(t.isNotNull() & _hit_on(rule, t), F.lit(False))) for t in map(field, rule.fields)]


def regex_hit(rule: Rule) -> Column:
    return _some([hit for _, hit in _on_targets(rule)])


def regex_evidence(rule: Rule, make=None) -> Column:
    """The match, or what ``make`` (text, rule) gives, of the first field that hits; of the whole text if there are none."""
    make = make or (lambda t, r: _evidence(r, t))
    if not rule.fields:
        return make(F.col("_text"), rule)
    return F.coalesce(*[F.when(hit, make(t, rule)) for t, hit in _on_targets(rule)])


# --- keywords ----------------------------------------------------------------------------------------------


def _holds(rule: Rule, keyword: str) -> Column:
    return F.col("_text").contains(keyword) if rule.case_sensitive else F.col("_lower").contains(keyword.lower())


def keyword_hit(rule: Rule) -> Column:
    return _some([_holds(rule, k) for k in rule.keywords])


def keyword_evidence(rule: Rule) -> Column:
    """The first of the list that the text holds."""
    return F.coalesce(*[F.when(_holds(rule, k), F.lit(k)) for k in rule.keywords])


def keyword_match(rule: Rule) -> tuple[Column, Column]:
    return keyword_hit(rule), keyword_evidence(rule)


# --- Sigma -------------------------------------------------------------------------------------------------


def _as_text(value) -> str:
    return {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)


def sigma_compare(key: str, value) -> Column:
    """One entry of a selection, ``field`` or ``field|modifier``; a list of values is an OR; missing fields don't match."""
    name, _, how = key.partition("|")
    col = field(name)
    test = {
        "startswith": lambda v: col.startswith(v),
        "endswith": lambda v: col.endswith(v),
        "contains": lambda v: col.contains(v),
        "re": lambda v: _matches(col, v),
    }.get(how, lambda v: col == v)
    values = value if isinstance(value, list) else [value]
    return F.coalesce(_some([test(_as_text(v)) for v in values]), F.lit(False))


def _matches(col: Column, pattern: str) -> Column:
    try:
        return _found(col, to_jvm(pattern))
    except UnsupportedPattern:
        return F.lit(False)


def sigma_selection(definition) -> Column:
    """A mapping is the AND of its entries, a list of mappings their OR; anything else never matches."""
    if isinstance(definition, dict):
        return _all([sigma_compare(k, v) for k, v in definition.items()]) if definition else F.lit(True)
    if isinstance(definition, list):
        return _some([sigma_selection(d) for d in definition if isinstance(d, dict)])
    return F.lit(False)


class AlwaysFails(ValueError):
    """The rule would break the evaluator that it is in, on every event."""


def _joined(a: Column, op: str, b: Column) -> Column:
    return a & b if op == "and" else a | b


def _quantified(m: re.Match, named: dict[str, Column]) -> Column:
    chosen = [c for name, c in named.items() if name.startswith(m["prefix"])]
    return (_some if m["n"] == "1" else _all)(chosen)


def _inner(m: re.Match, named: dict[str, Column]) -> Column:
    return _parity_condition(m["group"], named) if m["group"].strip() else _all(list(named.values()))


def _word_and_group(m: re.Match, named: dict[str, Column]) -> Column:
    return _joined(_named(re.sub(rf"(?:{m['op']})+$", "", m["a"]), named), m["op"], _inner(m, named))


def _group_as_a_word(m: re.Match, named: dict[str, Column]) -> Column:
    return _parity_condition(f"{m['head']} {_GROUP} {m['tail']}", named | {_GROUP: _inner(m, named)})


def _broken(m: re.Match, named: dict[str, Column]) -> Column:
    raise AlwaysFails(m[0])


def _named(name: str, named: dict[str, Column]) -> Column:
    return named.get(name.strip(), F.lit(False))


_GROUP = "<group>"
# The conditions that decisions must agree in, as shapes; the first that fits the whole text counts.  What follows a
# group that a word and an operator lead isn't read.
_PARITY_SHAPES = [
    (r"(?P<n>1|all) of (?P<prefix>.*?)\**", _quantified),
    (r"(?P<a>\S+)", lambda m, named: _named(m["a"], named)),
    (r"(?P<a>\S+)\s+and\s+not\s+(?P<b>\S+)", lambda m, named: _named(m["a"], named) & ~_named(m["b"], named)),
    (r"(?P<a>\S+)\s+(?P<op>and|or)\s+(?P<b>\S+)", lambda m, named: _joined(_named(m["a"], named), m["op"], _named(m["b"], named))),
    (r"(?P<a>[^(]*?)\s*(?P<op>and|or)\s*\((?P<group>.*)\)[^)]*", _word_and_group),
    (r"(?P<head>[^(]*)\((?P<group>.*)\)(?P<tail>[^)]*)", _group_as_a_word),
    (r"[^(]*\)[^)]*\(.*", _broken),
]


def _parity_condition(text: str, named: dict[str, Column]) -> Column:
    """A condition of one of the shapes above; any other means that all selections match."""
    for shape, build in _PARITY_SHAPES:
        if m := re.fullmatch(shape, text.strip(), re.S):
            return build(m, named)
    return _all(list(named.values()))


_SIGMA_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def _standard_condition(text: str, named: dict[str, Column]) -> Column:
    """Sigma's own grammar: not before and before or, quantifiers over names, patterns and ``them``."""
    tokens = _SIGMA_TOKEN.findall(text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while peek() == "and":
            take()
            out = out & one()
        return out

    def one() -> Column:
        word = take()
        if word == "not":
            return ~one()
        if word == "(":
            out = either()
            if not peek() == ")":
                raise ValueError(f"a parenthesis isn't closed in {text!r}")
            take()
            return out
        if word in ("1", "all") and peek() == "of":
            take()
            name = take()
            chosen = [c for n, c in named.items() if name == "them" or re.fullmatch(re.escape(name).replace(r"\*", ".*"), n)]
            return _some(chosen) if word == "1" else _all(chosen)
        if word not in named:
            raise ValueError(f"no selection {word!r} in {text!r}")
        return named[word]

    out = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} isn't expected in {text!r}")
    return out


def sigma_condition(condition: str, selections: dict, mode: str = "parity") -> Column:
    """A condition over named selections; ``mode``: ``parity`` or ``standard``."""
    named = {k: sigma_selection(v) for k, v in selections.items()}
    if not condition:
        return _all(list(named.values()))
    return _parity_condition(condition, named) if mode == "parity" else _standard_condition(condition, named)


# --- CEL ---------------------------------------------------------------------------------------------------

_CEL_TOKEN = re.compile(r"""(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>&&|\|\||==|!=|!|\(|\)|,)""", re.S)
_METHODS = ("contains", "startsWith", "endsWith", "matches")


def _unquote(token: str) -> str:
    return re.sub(r"\\([\\nt])", lambda m: {"\\": "\\", "n": "\n", "t": "\t"}[m[1]], token[1:-1])


class _Value:
    """A boolean or string column that is null where evaluating it fails."""

    def __init__(self, col: Column, is_bool: bool, literal: str | None = None):
        self.col, self.is_bool, self.literal = col, is_bool, literal

    @property
    def text(self) -> Column:
        return self.col.cast("string") if self.is_bool else self.col

    @property
    def truth(self) -> Column:
        return self.col if self.is_bool else self.col != ""


def _cel_and(a: _Value, b: _Value) -> _Value:
    return _Value(F.when(a.truth.isNull(), None).when(~a.truth, F.lit(False)).otherwise(b.truth), True)


def _cel_or(a: _Value, b: _Value) -> _Value:
    return _Value(F.when(a.truth.isNull(), None).when(a.truth, F.lit(True)).otherwise(b.truth), True)


class _Cel:
    def __init__(self, expr: str, mode: str):
        self.tokens = [(m.lastgroup, m[0]) for m in _CEL_TOKEN.finditer(expr)]
        self.at, self.mode = 0, mode

    def peek(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text if kind == "op" else ""

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def either(self) -> _Value:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = _cel_or(out, self.both())
        return out

    def both(self) -> _Value:
        out = self.equality()
        while self.peek() == "&&":
            self.take()
            out = _cel_and(out, self.equality())
        return out

    def equality(self) -> _Value:
        out = self.unary()
        while self.peek() in ("==", "!="):
            op = self.take()[1]
            other = self.unary()
            same = out.text == other.text
            out = _Value(same if op == "==" else ~same, True)
        return out

    def unary(self) -> _Value:
        if self.peek() != "!":
            return self.methods(*self.primary())
        self.take()
        if self.mode == "standard":
            return _Value(~self.unary().truth, True)
        # the negation is done before a method is called on its result
        value, call = self.primary() if self.peek() != "!" else (self.unary(), None)
        return self.methods(_Value(~value.truth, True), call)

    def primary(self) -> tuple[_Value, str | None]:
        """A value, and the method that its name ends with."""
        kind, text = self.take()
        if text == "(":
            out = self.either()
            self.take()
            return out, self.trailing()
        if kind == "str":
            return _Value(F.lit(_unquote(text)), False, _unquote(text)), self.trailing()
        if kind == "name":
            name, dot, last = text.rpartition(".")
            if dot and last in _METHODS and self.peek() == "(":
                return self.identifier(name), last
            return self.identifier(text), None
        return _Value(F.lit(None).cast("boolean"), True), None

    def trailing(self) -> str | None:
        """A method call after a closing parenthesis or a literal: its dot isn't a token, its name is."""
        if self.at < len(self.tokens) - 1 and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] in _METHODS and self.tokens[self.at + 1][1] == "(":
            return self.take()[1]
        return None

    def identifier(self, name: str) -> _Value:
        if name in ("true", "false"):
            return _Value(F.lit(name == "true"), True)
        return _Value(activation(name.replace(".", "_")), False)

    def methods(self, value: _Value, call: str | None) -> _Value:
        while call:
            self.take()  # (
            arg = self.either()
            self.take()  # )
            t = value.text
            if call == "matches":
                found = _matches(t, arg.literal) if arg.literal is not None else F.lit(None).cast("boolean")
            else:
                found = {"contains": t.contains, "startsWith": t.startswith, "endsWith": t.endswith}[call](arg.text)
            value, call = _Value(F.when(t.isNotNull(), found), True), self.trailing()
        return value


def cel_predicate(expr: str, mode: str = "parity") -> Column:
    """Whether an expression is true; null where it fails (a missing field), which is no match.

    ``mode`` ``parity`` applies ``!`` before a method call on what follows it, ``standard`` after.
    """
    value = _Cel(expr, mode).either()
    return value.col if value.is_bool else F.lit(False)
