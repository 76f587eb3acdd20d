"""Per-stage counts (P5) via ``DataFrame.observe``: computed by the job that
runs anyway, no extra pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter named after ``stage``; read ``obs.get`` after an action."""
    obs = Observation(stage)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
