"""Functions for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phaseflow.operators import segments


def _phase_marks(sequence: pd.Series, phases: pd.Series) -> pd.Series:
    def one(x, p):
        if x is None or p is None or len(x) < max(2, p) or not np.isfinite(np.array(x, float)).all():
            return None
        return segments.divisions(segments.fused_matrix([np.array(x, float)], [1.0], [segments.SMOOTHING]), int(p)).get(int(p))

    return pd.Series([one(x, p) for x, p in zip(sequence, phases, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """``phase_marks(array<double>, int)``: the best division of a sequence, null where it is too short."""
    spark.udf.register("phase_marks", F.pandas_udf(_phase_marks, "array<int>"))
