"""Names are normalised once per distinct text, and read from a table afterwards."""

import pytest
from pyspark.sql import functions as F

from lineloom.catalog import load
from lineloom.functions.text import normalize_name
from lineloom.operators import aggregates as G
from lineloom.operators import names as N

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["name_map_back", "name_variant_report", "name_reduction_stats", "curation_chain", "name_centroids"])
def test_rows_are_not_normalised_again(spark, query):
    plan = load().QUERIES[query](spark, SMALL)._jdf.queryExecution().toString()
    assert R"[\s_\-]+" not in plan


def test_texts_give_the_names_of_the_rules(spark):
    raws = ["gamma  Cas", "GAMMA CAS", "HD 12", None, "hd_12", "", "gamma", "alpha_-And*", "V0012 Cas", "V 5"]
    rows = [(i, raws[i % len(raws)], 1.0 * (i % 3), 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, raw string, ra double, dec double")
    texts = N.name_texts(df)
    assert texts.count() == len(raws) - 1
    got = N.apply_texts(df, texts, N.merge_names(df, texts=texts)).orderBy("id").collect()
    want = N.apply_canonical(df.withColumn("name", normalize_name("raw")), N.merge_names(df)).orderBy("id").collect()
    assert len(got) == 200 and [(r.id, r.name, r.star_name) for r in got] == [(r.id, r.name, r.star_name) for r in want]
    assert all((r.name is None) == (r.raw is None) for r in got)


def test_median_of_entity_sizes_reads_written_sizes(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("raw"), (F.col("id") % 3).cast("string").alias("star"))
    out = G.reduction_stats(df, ["raw", "star"], "star")
    assert "Range (" not in out._jdf.queryExecution().toString()
    assert out.first().asDict() == {"distinct_raw": 7, "distinct_star": 3, "mean_rows": 1000 / 3, "max_rows": 334, "n_ge_100": 3, "n_ge_10": 3, "n_eq_1": 0, "median_rows": 333.0}
