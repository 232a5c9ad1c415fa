"""From prediction tables to the run summary and the best run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from phenoline.operators.errors import best_runs, run_summary


def compare_runs(
    predictions: DataFrame, sim_ids: Sequence[int] = (1, 2, 3, 4), std_mode: str = "reference"
) -> tuple[DataFrame, DataFrame]:
    """Summary per run and cutoff share, and the best run per event."""
    summary = run_summary(predictions, cutoff="fraction", std_mode=std_mode)
    return summary, best_runs(summary, sim_ids)
