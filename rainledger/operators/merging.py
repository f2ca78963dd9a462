"""Joining observations with intervention records, and audits of that join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import BROADCAST_BYTES, HOT_KEY_ROWS, skew_join
from ..schema import require_columns, require_rows

KEYS = ("location_id", "year")
AVAILABLE = "nrm_data_available"


def merge_interventions(obs: DataFrame, nrm: DataFrame, on: Sequence[str] = KEYS, *,
                        suffix: str = "_nrm", null_safe: bool = False, strict: bool = False,
                        max_broadcast_bytes: int = BROADCAST_BYTES,
                        hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Keep every observation, add the intervention columns, and flag whether there was a match.

    Duplicate keys on the right multiply rows (see ``duplicate_keys``). Columns on both sides get
    ``suffix`` on the right. The right side is measured before it is broadcast.
    """
    if not on:
        raise ValueError("merge keys cannot be empty")
    require_columns(obs, *on)
    require_columns(nrm, *on)
    if strict:
        require_rows(obs, "observations")
    obs, nrm = obs.drop(AVAILABLE), nrm.drop(AVAILABLE)
    overlap = {c: c + suffix for c in nrm.columns if c in obs.columns and c not in on}
    right = nrm.withColumnsRenamed(overlap).withColumn(AVAILABLE, F.lit(True))
    joined = skew_join(obs, right, list(on), "left", null_safe=null_safe,
                       max_bytes=max_broadcast_bytes, hot_rows=hot_rows)
    return joined.withColumn(AVAILABLE, F.coalesce(F.col(AVAILABLE), F.lit(False)))


def without_interventions(obs: DataFrame) -> DataFrame:
    """The merged shape when there are no intervention records."""
    return obs.withColumn(AVAILABLE, F.lit(False))


def merge_report(merged: DataFrame) -> DataFrame:
    """Matched and unmatched rows, match rate in percent, and whether it is below one half."""
    require_columns(merged, AVAILABLE)
    matched = F.coalesce(F.sum(F.col(AVAILABLE).cast("long")), F.lit(0))
    counts = merged.agg(F.count(F.lit(1)).alias("total_records"), matched.alias("matched_records"))
    total, hit = F.col("total_records"), F.col("matched_records")
    rate = F.coalesce(F.try_divide(hit * 100.0, total), F.lit(0.0))
    return counts.select("total_records", "matched_records", (total - hit).alias("unmatched_records"),
                         rate.alias("match_rate_pct"), (rate < 50).alias("low_match"))


def duplicate_keys(df: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Rows beyond the first of each key; NULL keys are equal to each other."""
    require_columns(df, *on)
    groups = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
