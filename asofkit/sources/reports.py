"""Small aggregated results as JSON and Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings of the published tables.
METHOD_COLUMNS = {
    "recall_at_50": "Recall@50",
    "ndcg_at_10": "NDCG@10",
    "mrr_at_50": "MRR@50",
    "new_recall_at_50": "New-item Recall@50",
    "new_ndcg_at_10": "New-item NDCG@10",
}


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document per row, in a single file: for reports only."""
    rows.repartition(1).write.mode("overwrite").json(path)


def formatted(rows: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Label and metric cells as text, four decimals."""
    cells = [F.format_string("%.4f", F.col(c)).alias(title) for c, title in columns.items()]
    return rows.select(F.col(label), *cells)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report frame; more than ``limit`` rows are an error, nothing is cut."""
    table = rows.limit(limit + 1).collect()
    if len(table) > limit:
        raise ValueError(f"a report of more than {limit} rows")

    def line(cells: Sequence[object]) -> str:
        return "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"

    head = [line(rows.columns), "|" + "---|" * len(rows.columns)]
    return "\n".join(head + [line(r) for r in table]) + "\n"


def mean_and_deviation(summary: DataFrame) -> DataFrame:
    """Append ``cell``: mean, or mean and deviation where there was more than one run."""
    both = F.format_string("%.4f ± %.4f", F.col("mean"), F.col("std"))
    return summary.withColumn("cell", both)
