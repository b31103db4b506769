"""The given tables seen as observations, metadata, coverage, names, arrays, vectors and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.functions.arrays import total
from lineloom.functions.scalars import to_mjd
from lineloom.operators.skew import row_numbers
from lineloom.operators.windows import context_window

# Instrument text parts and the names the rules give them: fixed values of the test tables.
TELESCOPE_TEXT = ["C14", "Celestron C 11", "RC400", "CDK 17", "Newton 254", "LX200 16", "T600", "EdgeHD 8", "SC25", "FSQ-106",
                  "VC200L", "Askar 120", "@OHP193", "0.6m", "MEADE 14"]
TELESCOPE_NAME = ["C14", "C11", "RC400", "CDK17", "Newton_254mm", "Meade_LX200", "T600", "C8", "SC25", "Takahashi_FSQ106",
                  "Vixen_VC200L", "Askar_120", "OHP_T193", "T60cm", "Meade_14inch"]
SPECTROGRAPH_TEXT = ["eShel2", "LHIRES3", "Alpy 600", "LISA", "StarEx", "UVEX", "Dados", "SOPHIE", "MUSICOS", "NOU_T", "Elodie"]
SPECTROGRAPH_NAME = ["eShel", "LhiresIII", "Alpy600", "LISA", "StarEx", "UVEX", "Dados", "SOPHIE", "MUSICOS", "NOU_T", "Elodie"]
DETECTOR_TEXT = ["ATIK 460EX", "ASI 183", "QSI583", "QHY 163", "SBIG ST8300", "Audine KAF400", "Canon 350"]
DETECTOR_NAME = ["Atik460", "ASI183", "QSI583", "QHY163", "SBIG_ST8300", "Audine400", "Canon350"]


def _pick(values: list[str], key: str, mod: int):
    """Entry of a list by key, NULL when the remainder lies past its end."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % mod).cast("int"))


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def obs(self) -> DataFrame:
        """Events as observations of users."""
        e, u = F.col("event_id"), F.col("user_id")
        kind = (F.when(u % 4 == 0, "amateur").when(u % 4 == 1, "professional").when(u % 4 == 2, "other"))
        return self.raw("events").select(
            F.concat(F.lit("U"), u.cast("string")).alias("star_name"), e.alias("row_id"), to_mjd("ts").alias("mjd"),
            F.col("value").alias("ew"), F.col("event_type").alias("cls"), F.when(e % 17 != 0, F.col("value")).alias("snr"),
            (u * 0.25).alias("ra"), (u * 0.125 - 30).alias("dec"), kind.alias("observer_type"),
            F.when(e % 23 != 0, F.col("event_type") == "error").alias("is_echelle_order"))

    @property
    def meta(self) -> DataFrame:
        """Orders as catalogue rows."""
        k, p = F.col("o_orderkey"), F.col("o_totalprice")
        exptime = F.when(k % 19 != 0, F.when(k % 29 == 0, 0.0).otherwise(p / 10))
        mjd = to_mjd("o_orderdate")
        tel, spec, det = (_pick(TELESCOPE_TEXT, "o_orderkey", 17), _pick(SPECTROGRAPH_TEXT, "o_orderkey", 13),
                          _pick(DETECTOR_TEXT, "o_orderkey", 9))
        start = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        return self.raw("orders").select(
            k.alias("id"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("star_name"),
            F.when(k % 41 != 0, mjd).alias("mjd"), F.when(k % 13 != 0, p / 1000).alias("snr"),
            F.when(k % 11 != 0, p / 20).alias("spectral_resolution"), exptime.alias("exptime"),
            ((k % 3600) / 10).alias("lon"), ((k % 1800) / 10 - 90).alias("lat"), ((k % 4000) * 1.0).alias("elev"),
            F.nullif(F.concat_ws(" ", tel, spec, det), F.lit("")).alias("raw"),
            _pick(SPECTROGRAPH_NAME, "o_orderkey", 13).alias("spectrograph"),
            F.when(k % 7 == 0, F.concat(F.lit("IUE "), F.col("o_orderstatus"))).otherwise(F.col("o_orderpriority")).alias("instrument"),
            F.when(k % 37 == 0, "unknown").otherwise(start).alias("date_obs"),
            (mjd + exptime / 86400.0 / 2 + (k % 5) * 0.4 / 86400.0).alias("mjd_mid"),
            F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
            (k % 3).alias("n_points"), (F.lit(4000.0) + p / 1000).alias("lambda_start"))

    @property
    def coverage(self) -> DataFrame:
        """Line items as wavelength ranges."""
        k = F.col("l_orderkey")
        lo = F.lit(4000.0) + F.col("l_extendedprice") / 30
        return self.raw("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("star_name"),
            F.when(k % 43 != 0, to_mjd("l_shipdate")).alias("mjd"), F.when(k % 31 != 0, lo).alias("lambda_min"),
            F.when(k % 31 != 0, lo + F.col("l_quantity") * 20).alias("lambda_max"),
            (F.col("l_returnflag") == "R").alias("is_echelle_order"), F.when(k % 5 != 0, F.col("l_linestatus")).alias("observer_type"),
            F.when(k % 6 != 0, F.col("l_extendedprice") / 8).alias("spectral_resolution"),
            F.when(k % 9 != 0, F.col("l_extendedprice") / 300).alias("snr"))

    @property
    def names(self) -> DataFrame:
        """Parts and customers as loosely spelled objects with positions."""
        def form(key, text):
            return (F.when(key % 6 == 0, F.upper(text)).when(key % 6 == 1, F.replace(text, F.lit(" "), F.lit("_")))
                    .when(key % 6 == 2, F.concat(F.lit("hd  "), (key % 500).cast("string")))
                    .when(key % 6 == 3, F.concat(F.lit("V0"), (key % 400 + 1).cast("string"), F.lit(" Cas")))
                    .when(key % 6 == 4, F.concat(F.lit("gamma-"), F.substring(text, 1, 3), F.lit("+")))
                    .otherwise(F.concat((key % 90 + 1).cast("string"), F.lit("Cyg"))))
        p, c = F.col("p_partkey"), F.col("c_custkey")
        parts = self.raw("part").select(
            F.concat(F.lit("p"), p.cast("string")).alias("id"), form(p, F.col("p_name")).alias("raw"),
            F.when(p % 37 != 0, F.col("p_size") / 50).alias("ra"), F.when(p % 37 != 0, F.col("p_retailprice") / 1000).alias("dec"))
        cust = self.raw("customer").select(
            F.concat(F.lit("c"), c.cast("string")).alias("id"), form(c, F.col("c_name")).alias("raw"),
            ((c % 200) / 100).alias("ra"), (F.lit(1.0) + (c % 77) / 100).alias("dec"))
        return parts.unionByName(cust)

    def _arrays(self, rows: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
        """Runs of at most ``size`` ordered values per key."""
        r = row_numbers(rows, [key], order, "_rn").withColumn("seg", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long"))
        got = r.groupBy(key, "seg").agg(F.array_sort(F.collect_list(F.struct("_rn", value))).alias("_a"), F.min("mjd").alias("mjd"))
        return got.select(F.concat_ws(":", key, F.col("seg").cast("string")).alias("spectrum_id"), F.col(key).alias("star_name"), "mjd",
                          F.transform("_a", lambda s: s[value]).alias("_v"))

    @property
    def arrays_ev(self) -> DataFrame:
        """Users' readings as spectra around the first line, at most 128 points each."""
        a = self._arrays(self.obs, "star_name", ["mjd", "row_id"], "ew", 128)
        n = F.size("_v")
        wl = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(6462.8) + F.lit(200.0) * i / F.greatest(n - 1, F.lit(1)))
        a = a.withColumn("wavelength", wl).withColumn("flux", F.transform("_v", lambda v: v / 100 + 1)).drop("_v")
        return (a.withColumn("lambda_min", F.array_min("wavelength")).withColumn("lambda_max", F.array_max("wavelength"))
                .withColumn("snr", F.element_at("flux", 1) * 8).withColumn("velocity", F.element_at("flux", -1) * 10))

    @property
    def arrays_li(self) -> DataFrame:
        """Suppliers' prices as wide spectra, at most 640 points each."""
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
        rows = self.raw("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("star_name"), *order,
                                           to_mjd("l_shipdate").alias("mjd"))
        a = self._arrays(rows, "star_name", order, "l_extendedprice", 640)
        wl = F.transform(F.sequence(F.lit(0), F.size("_v") - 1), lambda i: F.lit(4000.0) + i * 5.0)
        a = a.withColumn("wavelength", wl).withColumn("flux", F.transform("_v", lambda v: v / 50000)).drop("_v")
        return a.withColumn("lambda_min", F.array_min("wavelength")).withColumn("lambda_max", F.array_max("wavelength"))

    @property
    def vec(self) -> DataFrame:
        """Embeddings with strata and two made-up targets, one linear and one curved in the vector."""
        v, d = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double"))
        y = total(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))
        y2 = total(F.transform(d, lambda x, i: x * x * (i % 5).cast("double")))
        return self.raw("embeddings").select(
            v.alias("row_id"), F.col("embedding").alias("z"), F.col("label"), F.concat(F.lit("E"), F.col("label").cast("string")).alias("star_name"),
            (v % 3).cast("int").alias("cls"), ((v * 37) % 400).cast("double").alias("snr"), y.alias("y"), y2.alias("y2"),
            (v * 0.5).alias("mjd"))

    @property
    def text(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source")

    @property
    def results(self) -> DataFrame:
        """Line items as scores per feature, representation, seed and variant."""
        return (self.raw("lineitem").select(
            F.concat(F.lit("f"), (F.col("l_partkey") % 6).cast("string")).alias("feature"),
            F.concat(F.lit("rep"), (F.col("l_suppkey") % 4).cast("string")).alias("representation"),
            (F.col("l_linenumber") % 3).cast("int").alias("seed"), F.col("l_returnflag").alias("variant"), "l_discount")
            .groupBy("feature", "representation", "seed", "variant")
            .agg(F.round(F.avg("l_discount") * 10, 9).alias("value"), F.round(F.stddev_samp("l_discount"), 6).alias("r2_std")))

    @property
    def pred(self) -> DataFrame:
        """Mean of the last five readings as a forecast of the next."""
        c = context_window(self.obs.select("star_name", "mjd", "row_id", "ew", "cls"), "star_name", ["mjd", "row_id"], "ew", 5,
                           out="ctx", with_lag={"ew": "y_persist", "mjd": "_t0"})
        return c.select(F.col("cls").alias("config"), "star_name", "mjd", "row_id", (F.col("mjd") - F.col("_t0")).alias("dt_days"),
                        F.col("ew").alias("y_true"), (total(F.col("ctx")) / 5).alias("y_pred"), "y_persist")
