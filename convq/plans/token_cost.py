"""Count tokens of all sized conversations and price them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convq.operators import costs
from convq.sources import sinks


def token_cost_run(messages: DataFrame, path: str, tokenizer=None) -> dict[str, DataFrame]:
    """Token rows are written once as CSV per class; statistics read them back."""
    rows = costs.token_rows(messages, tokenizer)
    sinks.write_csv(rows, f"{path}/tokens", partition_by="length_category")
    stored = (
        messages.sparkSession.read.option("header", True)
        .schema(rows.schema)
        .csv(f"{path}/tokens")
    )
    stats = costs.token_stats(stored)
    breakdown = costs.cost_breakdown(stats)
    result = {
        "token_stats": stats,
        "cost_breakdown": breakdown,
        "cost_summary": costs.cost_summary(breakdown),
    }
    for name, table in result.items():
        sinks.write_csv(table, f"{path}/{name}")
    return result
