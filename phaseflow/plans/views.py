"""The stages as views, so that SQL can ask for them: ``packets``, ``flows``, ``sequences``, ``marks``, ``phases``, ``meter``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow.config import Config
from phaseflow.functions import udfs
from phaseflow.operators import features, sessionize, split
from phaseflow.plans import pipeline


def register(spark: SparkSession, packets: DataFrame, config: Config | None = None, phases: int | None = None) -> None:
    """Temporary views over ``packets``; nothing runs until one is read, and each reads what it needs only.

    ``phases`` is the number of phases that ``phases`` and ``meter`` show (the first of the settings if left out).
    """
    config = config or Config()
    wanted = phases or config.num_phases[0]
    udfs.register(spark)
    assembled = pipeline.assembled(packets, config)
    marks = pipeline.marked(assembled, config, sorted({*config.num_phases, wanted}))
    phased = split.with_phase(assembled, marks.filter(F.col("num_phases") == wanted), pipeline.FLOW)
    views = {
        "packets": features.with_features(assembled),
        "flows": sessionize.flows(assembled),
        "sequences": features.sequences(features.with_features(assembled), features.checked(config.feature_types)),
        "marks": marks,
        "phases": phased,
        "meter": pipeline.metered(phased, config),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
