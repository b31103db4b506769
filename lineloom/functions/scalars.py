"""Column expressions for predicates, labels and unit handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MJD_UNIX_EPOCH = 40587.0
US_PER_DAY = 86_400_000_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def wrap_longitude(col) -> Column:
    """Longitude in degrees, values above 180 moved to the western half."""
    c = _c(col)
    return F.when(c > 180, c - 360).otherwise(c)


def temporal_quality(mjd, exptime, very_long: float = 36000.0) -> Column:
    m, e = _c(mjd), _c(exptime)
    return (F.when(m.isNull(), "missing").when(e.isNull() | (e == 0), "no_exptime")
            .when(e > very_long, "very_long").otherwise("good"))


SNR_LABELS = [(200.0, "excellent"), (100.0, "good"), (50.0, "medium"), (10.0, "low")]


def snr_quality(col, cuts=SNR_LABELS, lowest: str = "very_low") -> Column:
    c = _c(col)
    out = F.when(c.isNull(), "unknown")
    for cut, label in cuts:
        out = out.when(c >= cut, label)
    return out.otherwise(lowest)


def classify_by_list(col, values: list[str], hit="professional", miss="amateur", none="unknown",
                     ignore_case: bool = False) -> Column:
    """``hit`` when the value is in the list, ``miss`` otherwise; case-sensitive by default."""
    c = _c(col)
    key = F.lower(c) if ignore_case else c
    names = [v.lower() for v in values] if ignore_case else list(values)
    return F.when(c.isNull(), none).when(key.isin(names), hit).otherwise(miss)


def coarsen_geo(lat, lon, elev) -> tuple[Column, Column, Column]:
    """Privacy rounding, half to even: 0.1 degree and 100 metres."""
    return F.bround(_c(lat), 1), F.bround(_c(lon), 1), F.bround(_c(elev) / 100) * 100


def scale(col, factor: float = 1e10) -> Column:
    return _c(col) * F.lit(factor)


def covers(lo, hi, centre: float, half: float) -> Column:
    """Both window edges inside [lo, hi], edges included. Pushed down to scans of plain columns."""
    return (_c(lo) <= F.lit(centre - half)) & (_c(hi) >= F.lit(centre + half))


def resolution_family(flag, r, cuts=(1000.0, 3000.0, 8000.0)) -> Column:
    f, c = _c(flag), _c(r)
    a, b, d = cuts
    return (F.when(f, "echelle_order").when(c.isNull(), "single_unknown_R")
            .when(c < a, f"single_R_lt_{a:.0f}").when(c < b, f"single_R_{a:.0f}_{b:.0f}")
            .when(c < d, f"single_R_{b:.0f}_{d:.0f}").otherwise(f"single_R_ge_{d:.0f}"))


def to_mjd(ts) -> Column:
    """Timestamp to Modified Julian Date."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(US_PER_DAY) + F.lit(MJD_UNIX_EPOCH)


def mjd_to_timestamp(col) -> Column:
    return F.timestamp_micros(F.round((_c(col) - MJD_UNIX_EPOCH) * US_PER_DAY).cast("long"))


def mjd_to_year(col) -> Column:
    """Decimal year: calendar year plus the elapsed share of that year."""
    c = _c(col)
    ts = mjd_to_timestamp(c)
    year = F.year(ts)
    start = F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) + MJD_UNIX_EPOCH
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return year + (c - start) / days



def is_finite(col) -> Column:
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clip(col, lo: float = -100.0, hi: float = 100.0) -> Column:
    """Value limited to [lo, hi]; NULL where the input is missing or not finite."""
    c = _c(col)
    return F.when(is_finite(c), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


SEPARATORS = r"[_\-+]"


def norm_sep(col) -> Column:
    return F.regexp_replace(_c(col), SEPARATORS, " ")


def hash_bucket(key, salt: str, modulo: int = 100) -> Column:
    """First eight hex digits of md5("salt::key"), modulo ``modulo``."""
    digest = F.md5(F.concat(F.lit(salt + "::"), _c(key)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(modulo)


def hash_split(key, salt: str = "split", cuts=((70, "train"), (85, "validation")), rest: str = "test") -> Column:
    """Split by entity hash; the salt is the one the archive's splits were published with."""
    bucket = hash_bucket(key, salt)
    out = None
    for cut, name in cuts:
        out = F.when(bucket < cut, name) if out is None else out.when(bucket < cut, name)
    return out.otherwise(rest)


def time_split(col, cutoff: float = 59215.0) -> Column:
    """``train`` up to and including the cutoff, ``test`` strictly after it."""
    return F.when(_c(col) <= cutoff, "train").when(_c(col) > cutoff, "test")


def bucket_label(col, cuts: list[tuple[float, float | None, str]]) -> Column:
    """Label of the half-open range [lo, hi) holding the value; hi None means unbounded."""
    c, out = _c(col), None
    for lo, hi, name in cuts:
        cond = c >= lo if hi is None else (c >= lo) & (c < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def sample_hash(seed: int, *cols) -> Column:
    """Sampling order that depends only on the seed and the row's own key: the first 60 bits of an MD5, uniform from 0 to 2**60."""
    text = F.concat_ws("::", F.lit(str(seed)), *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
