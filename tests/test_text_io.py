"""Rules, names, schemas, files, splits and the stream."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lineloom.functions import rules as R
from lineloom.functions import scalars as S
from lineloom.functions.text import first_pattern, normalize_name, regex_cascade
from lineloom.operators import splits as P
from lineloom.operators.names import parse_instruments
from lineloom.sources import io, schemas
from lineloom.streaming.incremental import resume_batch, score_stream

NAMES = {
    "gam Cas": "GAM CAS", "gamma_Cas": "GAM CAS", "HD 5394": "HD5394", "V 442 And": "V442 AND", "V0404 Lac": "V404 LAC", "V0404": "V404",
    "11Cyg": "11 CYG", "_hd224544": "HD224544", "omega": "OMEGA", "Theta-CrB+": "TET CRB", "  kap   Dra * ": "KAP DRA", "BD +31": "BD+31",
    "mu": "MU", "123ABCD": "123ABCD", "eta Tau": "ETA TAU",
}

SETUPS = {  # text: (telescope, spectrograph, detector, confidence)
    "C14_eShel_ATIK460": ("C14", "eShel", "Atik460", "high"),
    "Feros@ESO2.2": ("ESO_2.2m", "FEROS", None, "high"),
    "SOPHIE": ("OHP_T193", "SOPHIE", None, "high"),
    "T0.18 LISA": ("T180mm", "LISA", None, "high"),
    "0.5m+LHIRES3+QHY163": ("T50cm", "LhiresIII", "QHY163", "high"),
    "Newton 10 alpy": ("Newton_10inch", "Alpy600", None, "high"),
    "SC30 x": (None, None, None, "low"),
    "SC25": ("SC25", None, None, "medium"),
    "SC08 dados": ("C8", "Dados", None, "high"),
    "LX200 thing": ("Meade_LX200", None, None, "medium"),
    "ES ST10": (None, None, None, "low"),
    "x ST10XME": (None, None, "SBIG_ST10", "medium"),
    "IUE_SWP": ("IUE", "IUE_SWP", None, "high"),
    "V10S2400": (None, "Compact_R2400", None, "medium"),
    "Sky Watcher 150 UVEX": ("SkyWatcher_150", "UVEX", None, "high"),
    "SkyWatcher UVEX": ("SkyWatcher", "UVEX", None, "high"),
    "DeniSe": (None, "DeniSe", None, "high"),
    "900mm": (None, None, None, "low"),
    "355mm DSI": ("T355mm", None, "Meade_DSI", "high"),
    "Nova 402": (None, "Unknown_grating", "Nova402", "high"),
    "12\" Audine": ("T12inch", None, "Audine", "high"),
}


def test_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "raw string").withColumn("n", normalize_name("raw"))
    assert {r["raw"]: r["n"] for r in df.collect()} == NAMES


def test_setups(spark):
    df = parse_instruments(spark.createDataFrame([(k,) for k in SETUPS], "raw string"))
    got = {r["raw"]: (r["telescope"], r["spectrograph"], r["detector"], r["confidence"]) for r in df.collect()}
    assert got == SETUPS


@pytest.mark.parametrize("table", [R.TELESCOPE_RULES, R.SPECTROGRAPH_RULES, R.DETECTOR_RULES])
def test_rule_tables_are_sound(table):
    for rule in table:
        assert re.compile(rule[0])
        opt = rule[2] if len(rule) > 2 else {}
        assert (rule[1] is None) == ("cases" in opt)


def test_first_rule_wins(spark):
    df = spark.createDataFrame([("ab12",), ("b7",), ("zz",)], "raw string")
    rules = [(r"a", "A"), (r"b(\d+)", None, {"cases": [(0, 9, "B{n}")]}), (r"b", "late")]
    assert [r[0] for r in df.select(regex_cascade("raw", rules)).collect()] == ["A", "B7", None]


def test_pattern_scan(spark):
    df = spark.createDataFrame([("see /HOME/x and /Users/y",), ("/users/y",), ("clean",)], "t string")
    assert [r[0] for r in df.select(first_pattern("t", R.LEAK_PATTERNS)).collect()] == ["/home/", "/users/", None]


def test_list_match_is_case_sensitive_unless_asked(spark):
    df = spark.createDataFrame([("AURELIE",), ("Aurelie",), (None,)], "s string")
    a = [r[0] for r in df.select(S.classify_by_list("s", R.PROFESSIONAL_SPECTROGRAPHS)).collect()]
    b = [r[0] for r in df.select(S.classify_by_list("s", R.PROFESSIONAL_SPECTROGRAPHS, ignore_case=True)).collect()]
    assert a == ["amateur", "professional", "unknown"] and b == ["professional", "professional", "unknown"]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.25, 0.35, 50.0), (0.75, -0.25, 150.0)], "a double, b double, e double")
    got = [tuple(r) for r in df.select(*S.coarsen_geo("a", "b", "e")).collect()]
    assert got == [(0.2, 0.4, 0.0), (0.8, -0.2, 200.0)]


def test_split_hash_is_stable(spark):
    import hashlib
    keys = [f"star {i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("b", S.hash_bucket("k", "salt"))
    want = {k: int(hashlib.md5(f"salt::{k}".encode()).hexdigest()[:8], 16) % 100 for k in keys}
    assert {r["k"]: r["b"] for r in df.collect()} == want


def test_conform(spark):
    df = spark.createDataFrame([(1, float("nan"), "x")], "a int, b double, c string")
    out = schemas.conform(df, schemas.ddl("c string, b double, d array<float>, a long"))
    assert out.columns == ["c", "b", "d", "a"] and tuple(out.first()) == ("x", None, None, 1)


def test_shards_and_split_files(spark, small, tmp_path):
    path = str(tmp_path / "shards")
    io.write_shards(small.raw("events"), path, rows=200)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) >= 5 and all("zstd" in f for f in files)
    assert spark.read.parquet(path).count() == small.raw("events").count()
    split = small.obs.select("star_name").distinct().withColumn("split", S.hash_split("star_name"))
    io.write_split_csv(split, str(tmp_path / "csv"))
    back = io.read_split_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, split.collect()))


def test_folds_are_equal_and_stable(small):
    a = P.assign_folds(small.obs.select("row_id"), 7)
    b = P.assign_folds(small.obs.select("row_id").repartition(13), 7, limit=100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(n) == 7 and max(n) - min(n) <= 1


def test_samples_do_not_depend_on_partitioning(small):
    def pick(df):
        return sorted(r["row_id"] for r in P.sample_entities(df.withColumn("split", S.hash_split("star_name")), "star_name", "split", n=2).collect())
    assert pick(small.obs) == pick(small.obs.repartition(11))


def test_stream_scores_each_file_once(spark, small, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    a = small.arrays_ev.select("spectrum_id", "wavelength", "flux")
    half = F.crc32("spectrum_id") % 2 == 0
    a.filter(half).write.parquet(src)
    score_stream(spark, src, a.schema, out, ck)
    n1 = spark.read.parquet(out).count()
    a.filter(~half).write.mode("append").parquet(src)
    score_stream(spark, src, a.schema, out, ck)
    score_stream(spark, src, a.schema, out, ck)
    got = spark.read.parquet(out)
    assert n1 == a.filter(half).count() and got.count() == a.count() == got.select("spectrum_id").distinct().count()
    assert resume_batch(a, got, "spectrum_id").count() == 0


def test_filters_differ_on_missing_snr(spark):
    from lineloom.operators.filters import filter_covering, filter_scoreable
    rows = [("a", 1.0, None, 6000.0, 7000.0, False), ("b", 1.0, 5.0, 6000.0, 7000.0, None), ("c", 1.0, 50.0, None, None, False), ("", 1.0, 50.0, 6000.0, 7000.0, True)]
    df = spark.createDataFrame(rows, "star_name string, mjd double, snr double, lambda_min double, lambda_max double, is_echelle_order boolean")
    assert [r["star_name"] for r in filter_covering(df, 6562.8, 50.0, False, 5.0).collect()] == ["b"]
    assert [r["star_name"] for r in filter_scoreable(df).collect()] == ["a", "c"]


def test_coverage_filter_reaches_the_scan(small, tmp_path):
    path = str(tmp_path / "cov")
    small.coverage.write.parquet(path)
    from lineloom.operators.filters import filter_covering
    small.spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for plan in (small.spark.read.parquet(path).filter(S.covers("lambda_min", "lambda_max", 6562.8, 50.0)),
                 filter_covering(small.spark.read.parquet(path), 6562.8, 50.0)):
        text = plan.select("star_name")._jdf.queryExecution().executedPlan().toString()
        pushed = text[text.index("PushedFilters"):]
        assert "LessThanOrEqual(lambda_min,6512.8)" in pushed and "GreaterThanOrEqual(lambda_max,6612.8)" in pushed
        assert "snr" not in text


def test_nearest_join_plan_has_no_product(small):
    from lineloom.operators.joins import nearest_join, radius_pairs
    o = small.obs.select("star_name", "mjd", "row_id", "ew")
    for df in (nearest_join(o, o, "star_name", "mjd", 0.1, "row_id"),
               radius_pairs(o.withColumn("y", F.col("ew")), "row_id", "ew", "y", 0.5)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_own_scratch_folder_can_be_dropped(spark, tmp_path):
    from lineloom.session import _own_folder, scratch_path
    assert scratch_path(spark).startswith(_own_folder(spark)) and spark.sparkContext.applicationId in _own_folder(spark)


def test_stored_arrays_are_not_shuffled_again(spark, tmp_path):
    from lineloom.sources import io
    arrays = spark.range(300).select((F.col("id") * 7 % 400).alias("id"), F.array(F.col("id").cast("double")).alias("flux"))
    stored = io.write_bucketed(arrays, "stored_arrays", f"{tmp_path}/arrays", "id", 16)
    meta = spark.range(400).select("id", F.lit(1).alias("n_pixels")).hint("merge")
    joined = io.assemble(meta, stored)
    assert joined.count() == arrays.select("id").distinct().count() == 300
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "Range" in plan[plan.rindex("Exchange hashpartitioning"):].splitlines()[1]
    spark.sql("DROP TABLE stored_arrays")
