"""Row filters on scalar columns, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.scalars import is_finite


def filter_covering(df: DataFrame, centre: float, half: float, include_flagged: bool = True,
                    min_snr: float | None = None) -> DataFrame:
    """Training-side filter: missing bounds count as 0; a missing SNR fails where a minimum is set.

    A missing lower bound therefore passes and a missing upper one fails; written so that the scan
    can use both tests.
    """
    low = F.col("lambda_min").isNull() | (F.col("lambda_min") <= centre - half)
    out = df.filter(low & (F.col("lambda_max") >= centre + half))
    if not include_flagged:
        out = out.filter(~F.coalesce("is_echelle_order", F.lit(False)))
    return out if min_snr is None else out.filter(F.col("snr") >= min_snr)


def filter_scoreable(df: DataFrame, min_snr: float = 10.0) -> DataFrame:
    """Feature-side filter: named and dated rows; a missing SNR passes, a finite low one does not."""
    low = F.coalesce(is_finite("snr") & (F.col("snr") < min_snr), F.lit(False))
    return df.filter((F.col("star_name") != "") & (F.col("mjd") > 0) & ~low)


def apply_flag_policy(df: DataFrame, policy: str, flag: str = "is_echelle_order") -> DataFrame:
    """``include``: all rows; ``exclude``: those not flagged; ``only``: those flagged. NULL is not flagged."""
    flagged = F.coalesce(F.col(flag), F.lit(False))
    tests = {"include": None, "exclude": ~flagged, "only": flagged}
    if policy not in tests:
        raise ValueError(f"unknown flag policy {policy!r}")
    return df if tests[policy] is None else df.filter(tests[policy])
