"""What becomes of decisions: enforcement, audit records, alerts, summaries, the rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.rules.model import Evaluator, in_order

DEFAULT_ALERTS = ("block", "redact")


def enforce(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, quarantined): blocked events apart; redacted text in place of results that redact decided on."""
    masked = F.when((F.col("action") == "redact") & F.col("redacted").isNotNull() & F.col("tool_result").isNotNull(), F.col("redacted")).otherwise(F.col("tool_result"))
    return decided.filter("not blocked").withColumn("tool_result", masked), decided.filter("blocked")


def audit_records(decided: DataFrame) -> DataFrame:
    """(value): a JSON line per decision, with its evaluators' results."""
    results = F.transform("results", lambda r: F.struct(r["evaluator"].alias("evaluator"), r["action"].alias("action"), r["confidence"].alias("confidence"), r["reason"].alias("reason")))
    return decided.select(F.to_json(F.struct("timestamp", "stage", "session_id", "user_id", "channel", "tool_name", "action", "blocked", "reasons", results.alias("evaluator_results")), {"ignoreNullFields": "false"}).alias("value"))


def write_audit(decided: DataFrame, path: str) -> None:
    audit_records(decided).write.mode("append").text(path)


def alert_feed(decided: DataFrame, actions: tuple[str, ...] = DEFAULT_ALERTS) -> DataFrame:
    """Decisions worth an alert: of the given actions (none given: block and redact)."""
    rows = decided.filter(F.col("action").isin(*(actions or DEFAULT_ALERTS)))
    return rows.select("timestamp", "stage", "session_id", "user_id", "channel", "tool_name", "action", "reasons", F.col("n_results").alias("evaluator_count"))


def detection_summary(decided: DataFrame, levels: bool = False) -> DataFrame:
    """Counts of results by stage, evaluator, rule and action; ``levels``: with subtotals."""
    rows = decided.select("stage", F.explode("results").alias("r")).select("stage", "r.evaluator", "r.rule_id", "r.action")
    keys = ("stage", "evaluator", "rule_id", "action")
    return (rows.rollup(*keys) if levels else rows.groupBy(*keys)).agg(F.count("*").alias("n"))


def rule_catalog(spark: SparkSession, evaluators: list[Evaluator]) -> DataFrame:
    """A row per rule, in the order in which they are tried."""
    rows = [(r.id, r.title, r.description, e.name, e.type, i, n, list(e.stages), r.action, r.category, r.priority, r.status, r.logsource) for i, e in enumerate(in_order(list(evaluators))) for n, r in enumerate(e.rules)]
    return spark.createDataFrame(rows, "rule_id string, title string, description string, evaluator string, eval_type string, ord int, nth int, stages array<string>, action string, category string, priority string, status string, logsource string")


def with_rule_metadata(hits: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ("category", "eval_type")) -> DataFrame:
    """``hits`` with columns of the catalogue, which has as many rows as there are rules, by rule_id."""
    return hits.join(F.broadcast(catalog.select("rule_id", *keep)), "rule_id", "left")


def last_user_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the last thing that the user said in each conversation."""
    said = conversations.filter("role = 'user'")
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
