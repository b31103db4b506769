"""The dataset build as one plan: metadata and arrays to the declared 35-column table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions import scalars as S
from lineloom.sources.io import assemble
from lineloom.sources.schemas import SPECTRA, conform


def build_dataset(meta: DataFrame, arrays: DataFrame, key: str = "id") -> DataFrame:
    """Rows found on both sides, cleaned and in the declared schema (one join, no driver work).

    ``meta`` may have any of the declared columns, and ``spectral_start`` and ``spectral_stop`` in metres;
    ``arrays`` has wavelength, flux, flux_error, n_pixels_extracted, fits_format. Bounds come from the header,
    else from the array; positions are coarsened; labels are derived where their inputs are there.
    """
    out = assemble(meta, arrays, key).withColumnRenamed(key, "spectrum_id")
    have = set(out.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    lat, lon, elev = S.coarsen_geo(col("site_latitude"), S.wrap_longitude(col("site_longitude")), col("site_elevation"))
    derived = {
        "lambda_min": F.coalesce(col("lambda_min"), S.scale(col("spectral_start")), F.array_min("wavelength").cast("double")),
        "lambda_max": F.coalesce(col("lambda_max"), S.scale(col("spectral_stop")), F.array_max("wavelength").cast("double")),
        "n_pixels": F.coalesce(col("n_pixels").cast("int"), F.size("wavelength")),
        "snr_quality": S.snr_quality(col("snr")),
        "temporal_quality": S.temporal_quality(col("mjd"), col("exposure_time")),
        "site_latitude": lat, "site_longitude": lon, "site_elevation": elev,
    }
    return conform(out.withColumns(derived), SPECTRA)
