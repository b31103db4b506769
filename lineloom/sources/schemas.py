"""Declared schemas and the projection that makes any table fit one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "long": T.LongType(),
         "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType())}


def ddl(text: str) -> T.StructType:
    """Schema from "name type, ..." without needing a session, so that modules load before one exists."""
    pairs = [p.split() for p in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


ARRAYS = ddl("id string, wavelength array<float>, flux array<float>, flux_error array<float>, "
             "n_pixels_extracted int, fits_format string")

SPECTRA = ddl(
    "wavelength array<float>, flux array<float>, flux_error array<float>, spectrum_id string, "
    "star_name string, star_name_raw string, ra double, dec double, lambda_min double, lambda_max double, "
    "n_pixels int, spectral_resolution double, spectral_resolution_measured double, snr double, "
    "snr_continuum double, snr_quality string, observation_date string, mjd double, exposure_time double, "
    "temporal_quality string, spectrograph string, telescope string, detector string, "
    "instrument_setup string, instrument_confidence string, observer_type string, site_latitude double, "
    "site_longitude double, site_elevation double, helio_velocity double, bss_rqvh double, "
    "telluric_corrected string, normalized string, is_echelle_order boolean, fits_format string")

SPLITS = ddl("star_name string, split string")

SLIM_COLUMNS = ["spectrum_id", "star_name", "mjd", "snr", "snr_continuum", "spectral_resolution",
                "observer_type", "observation_date", "lambda_min", "lambda_max", "is_echelle_order"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order and type; missing ones NULL, NaN doubles NULL."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)
