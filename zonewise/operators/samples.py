"""Sample rounds: substitution of non-detects, per-system statistics, stitching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewise.functions.numeric import detection_limit_or_zero, row_max, row_median, substitute_nondetect
from zonewise.operators.aggregate import any_detect, strict_max
from zonewise.operators.quantiles import exact_medians
from zonewise.operators.scale import join_groups


@dataclass(frozen=True)
class Source:
    """One review round of one analyte and how its samples are to be read."""

    analyte: str
    review: str
    substitute: bool = True  # fill missing readings from the detection limit
    strict_flag: bool = False  # a missing detection code makes the flag missing
    unit_scale: float = 1.0

    @property
    def label(self) -> str:
        return f"{self.analyte}_{self.review}"


def summarise(
    samples: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    limit: str | None = "detection_limit_value",
) -> DataFrame:
    """min, median, median detection level, mean, max and sd per group.

    With ``limit`` given, missing readings are first replaced by limit/sqrt(2).
    """
    keys = list(keys)
    ready = samples
    if limit is not None:
        ready = samples.withColumns(
            {
                value: substitute_nondetect(F.col(value), F.col(limit)),
                limit: detection_limit_or_zero(F.col(limit)),
            }
        )
    medians = {"median": value} if limit is None else {"median": value, "detect_level_med": limit}
    moments = ready.groupBy(*keys).agg(
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"),
    )
    return join_groups(moments, exact_medians(ready, keys, medians), keys).select(
        *keys, "min", *medians, "mean", "max", "sd"
    )


def review_medians(
    samples: DataFrame, sources: Sequence[Source], system: str = "pwsid", keep_components: bool = False
) -> DataFrame:
    """Median and detection flag of each analyte per system, over all its rounds.

    ``samples`` is long: (system, analyte, review, value, detection_limit_value,
    detect). Every round is reduced in the same two aggregations, whatever their
    number; a system missing from a round simply has no value there.
    """
    which = F.concat_ws("_", "analyte", "review")
    filled, raw = F.lit(None).cast("double"), F.col("value")
    reading = filled
    for s in sources:
        scaled = substitute_nondetect(raw, F.col("detection_limit_value")) if s.substitute else raw
        reading = F.when(which == s.label, scaled * s.unit_scale).otherwise(reading)
    keys = [system, "source"]
    ready = samples.where(which.isin([s.label for s in sources])).select(
        system, which.alias("source"), reading.alias("reading"), "detect"
    )
    flags = ready.groupBy(*keys).agg(
        any_detect(F.col("detect"), strict=True).alias("any_flag"),
        strict_max(F.col("detect")).alias("max_flag"),
    )
    per_round = join_groups(flags, exact_medians(ready, keys, {"median": "reading"}), keys)
    wide = per_round.groupBy(system).agg(
        *(
            F.max(F.when(F.col("source") == s.label, F.col(stat))).alias(f"{name}_{s.label}")
            for s in sources
            for name, stat in (("median", "median"), ("detect", "max_flag" if s.strict_flag else "any_flag"))
        )
    )
    analytes = list(dict.fromkeys(s.analyte for s in sources))
    final = {}
    for a in analytes:
        labels = [s.label for s in sources if s.analyte == a]
        final[f"{a}_fin_median"] = row_median(*(F.col(f"median_{n}") for n in labels))
        final[f"{a}_detect_flag"] = row_max(wide, [f"detect_{n}" for n in labels])
    stitched = wide.withColumns(final)
    if keep_components:
        return stitched
    return stitched.select(
        system, *(f"{a}_fin_median" for a in analytes), *(f"{a}_detect_flag" for a in analytes)
    )
