"""The curation chain over metadata rows. Building it runs jobs: lookups are written and measured, names are merged
round by round; what it returns is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions import rules as R
from lineloom.functions import scalars as S
from lineloom.operators.names import apply_lookup, apply_texts, build_lookup, merge_names, name_texts
from lineloom.operators.windows import combine_flags, structural_group_flag


def curate(df: DataFrame, radius: float = 0.01) -> DataFrame:
    """Columns raw, name_raw, ra, dec, lon, mjd, exptime, snr, n_points, lambda_start -> cleaned ones."""
    out = apply_lookup(df, build_lookup(df, "raw"), "raw")
    out = (out.withColumn("lon_clean", S.wrap_longitude("lon")).withColumn("temporal_quality", S.temporal_quality("mjd", "exptime"))
           .withColumn("snr_quality", S.snr_quality("snr"))
           .withColumn("observer_type", S.classify_by_list("spectrograph", R.PROFESSIONAL_SPECTROGRAPHS)))
    texts = name_texts(df, "name_raw")
    out = apply_texts(out, texts, merge_names(df, "name_raw", "ra", "dec", radius, texts), "name_raw")
    out = structural_group_flag(out, ["star_name", "mjd", "n_points"], "lambda_start")
    return combine_flags(out, F.col("spectrograph").isin(R.ECHELLE_SPECTROGRAPHS))
