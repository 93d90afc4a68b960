"""Ready-made jobs: one scan per category of the rule pack, and the whole pack."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigilake.operators.chain import evaluate
from vigilake.rules.pack import CATEGORIES, category, rule_pack

RATE_CATEGORY = "resource_abuse"


def scan(name: str, events: DataFrame) -> DataFrame:
    """Events on which a rule of the category fires: event_id, action, reasons joined by "; "."""
    from pyspark.sql import functions as F

    decided = evaluate(events, category(name), details=False)
    return decided.filter("action <> 'allow'").select("event_id", "action", F.array_join("reasons", "; ").alias("reasons"))


def decide(events: DataFrame, details: bool | str = True, partitions: int | None = None) -> DataFrame:
    """Every event's decision by the whole pack; ``details``: with results and masked texts ("verdicts": results without evidence)."""
    return evaluate(events, list(rule_pack()), details=details, partitions=partitions)


STATELESS = [c for c in CATEGORIES if c != RATE_CATEGORY]
