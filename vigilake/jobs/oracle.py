"""The rule pack's decisions in SQL, for checking: written from the rules' meaning, not from the columns that Spark runs."""

from __future__ import annotations

from vigilake.jobs.agent_log import events_sql
from vigilake.rules.model import Evaluator, in_order
from vigilake.rules.pack import EVALUATORS, category, rule_pack

# What each CEL rule says, in SQL.
CEL = {
    "cel-pol-001": r"tool_name = 'exec' AND regexp_matches(command, 'rm\s+-r')",
    "cel-pol-002": "tool_name = 'exec' AND contains(command, 'chmod 777')",
    "cel-pol-003": "tool_name = 'exec' AND starts_with(command, 'sudo')",
    "cel-pol-004": "tool_name = 'exec' AND (command IN ('env', 'printenv') OR contains(command, 'export'))",
    "cel-pe-001": r"tool_name = 'exec' AND regexp_matches(command, '^sudo\s')",
    "cel-pe-002": r"tool_name = 'exec' AND regexp_matches(command, '^su\s+-|^su\s+root')",
    "cel-pe-003": "tool_name = 'exec' AND contains(command, 'pkexec')",
    "cel-pe-004": r"tool_name = 'exec' AND regexp_matches(command, '^doas\s')",
    "cel-pe-005": r"tool_name = 'exec' AND regexp_matches(command, 'chown\s+root')",
    "cel-pe-006": "tool_name = 'exec' AND contains(command, 'chmod u+s')",
    "cel-pe-007": "tool_name = 'exec' AND (contains(command, 'visudo') OR contains(command, '/etc/sudoers'))",
    "cel-mm-001": "contains(command, 'system_prompt') OR contains(command, 'system_message')",
    "cel-mm-002": r"contains(command, 'temperature') AND regexp_matches(command, 'temperature.*(=|:)\s*[0-9]')",
    "cel-mm-003": r"""contains(command, 'tool_definitions') OR contains(command, '\"tools\"')""",
    "cel-mm-004": r"contains(command, 'max_tokens') AND regexp_matches(command, 'max_tokens.*(=|:)\s*[0-9]')",
}
_RAW = {r["id"]: r for e in EVALUATORS for r in e["rules"]}
_COLUMN = {"tool_name": "tool_name", "tool_args.command": "(CASE WHEN tool_name IS NOT NULL THEN command END)", "tool_args.path": "(CASE WHEN tool_name IS NOT NULL THEN path END)", "message_text": "message_text"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _compare(key: str, value) -> str:
    name, _, how = key.partition("|")
    col = _COLUMN[name]
    form = {"": "{c} = {v}", "contains": "contains({c}, {v})", "startswith": "starts_with({c}, {v})", "endswith": "ends_with({c}, {v})", "re": "regexp_matches({c}, {v})"}[how]
    values = value if isinstance(value, list) else [value]
    return "COALESCE(" + " OR ".join(form.format(c=col, v=quoted(v)) for v in values) + ", false)"


def predicate(rule_id: str, text: str = "txt") -> str:
    """Whether a rule hits a row of ``ev``."""
    raw = _RAW[rule_id]
    if "pattern" in raw:
        on = _COLUMN[raw["fields"][0]] if raw.get("fields") else text
        return f"COALESCE(regexp_matches({on}, {quoted(raw['pattern'])}), false)"
    if "keywords" in raw:
        return "(" + " OR ".join(f"contains(lower({text}), {quoted(k.lower())})" for k in raw["keywords"]) + ")"
    if "detection" in raw:
        parts = {k: " AND ".join(_compare(f, v) for f, v in s.items()) for k, s in raw["detection"].items() if k != "condition"}
        condition = raw["detection"]["condition"]
        if condition.count(" or ") > 1 or condition.count(" and ") > 1:  # more than the grammar to match has: all selections
            return "(" + " AND ".join(f"({p})" for p in parts.values()) + ")"
        out = "".join(f"({parts[w]})" if w in parts else f" {w} " if w in ("and", "or") else w for w in condition.replace("(", " ( ").replace(")", " ) ").split())
        return f"({out})"
    return f"COALESCE({CEL[rule_id]}, false)"


_PREFIX = {"regex": "Regex match: ", "pattern": "Pattern match: ", "sigma": "Sigma rule matched: "}


def _first(e: Evaluator, what: str) -> str:
    """CASE over an evaluator's rules: the first hit's action or reason."""
    cases = []
    for r in e.rules:
        out = r.action if what == "action" else r.id if what == "id" else r.reason if e.type == "cel" else _PREFIX[e.type] + r.title
        cases.append(f"WHEN {predicate(r.id)} THEN {quoted(out)}")
    stages = ", ".join(map(quoted, e.stages))
    return f"CASE WHEN stage NOT IN ({stages}) THEN NULL {' '.join(cases)} ELSE {quoted('allow') if what == 'action' else 'NULL'} END"


def decisions_sql(evaluators: list[Evaluator]) -> str:
    """(event_id, action, reasons, n_results) by evaluators that need no history, as CTEs ending in ``decided``."""
    es = [e for e in in_order(evaluators) if e.type != "sql"]
    firsts = ", ".join(f"{_first(e, 'action')} AS a{i}, {_first(e, 'reason')} AS r{i}" for i, e in enumerate(es))
    live = [" AND ".join(["true", *(f"COALESCE(a{j} <> 'block', true)" for j in range(i))]) for i in range(len(es))]
    action = "CASE WHEN " + " OR ".join(f"a{i} = 'block'" for i in range(len(es))) + " THEN 'block' WHEN " + " OR ".join(f"a{i} = 'redact'" for i in range(len(es))) + " THEN 'redact' WHEN " + " OR ".join(f"a{i} = 'detect'" for i in range(len(es))) + " THEN 'detect' ELSE 'allow' END"
    reasons = "concat_ws('; ', " + ", ".join(f"CASE WHEN {live[i]} AND a{i} <> 'allow' THEN r{i} END" for i in range(len(es))) + ")"
    count = " + ".join(f"CASE WHEN {live[i]} AND a{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(len(es)))
    return f"{events_sql()}, firsts AS (SELECT *, {firsts} FROM ev), decided AS (SELECT *, {action} AS action, {reasons} AS reasons, {count} AS n_results FROM firsts)"


def category_sql(name: str) -> str:
    return f"WITH {decisions_sql(category(name))} SELECT event_id, action, reasons FROM decided WHERE action <> 'allow'"


def pack_sql() -> str:
    return decisions_sql(list(rule_pack()))


def by_rule_sql(evaluators: list[Evaluator]) -> str:
    """(stage, evaluator, rule_id, action): a row per event and result by evaluators that need no history, from ``decided``."""
    each = []
    es = [e for e in in_order(evaluators) if e.type != "sql"]
    for i, e in enumerate(es):
        live = " AND ".join(["true", *(f"COALESCE(a{j} <> 'block', true)" for j in range(i))])
        each.append(f"SELECT stage, {quoted(e.name)} AS evaluator, {_first(e, 'id').replace(quoted('allow'), 'NULL')} AS rule_id, a{i} AS action FROM decided WHERE a{i} IS NOT NULL AND {live}")
    return " UNION ALL ".join(each)


def catalog_sql(evaluators: list[Evaluator]) -> str:
    """The rule catalogue as a VALUES list: rule_id, title, eval_type, ord, nth, category."""
    rows = [f"({quoted(r.id)}, {quoted(r.title)}, {quoted(e.type)}, {i}, {n}, {quoted(r.category)})" for i, e in enumerate(in_order(evaluators)) for n, r in enumerate(e.rules)]
    return f"(VALUES {', '.join(rows)}) AS c(rule_id, title, eval_type, ord, nth, category)"
