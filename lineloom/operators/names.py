"""Lookup tables from raw text and entity names merged by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions import rules as R
from lineloom.functions.text import fill_from_map, join_parts, match_confidence, normalize_name, regex_cascade
from lineloom.operators.joins import connected_components, radius_edges
from lineloom.operators.skew import group_stats, lookup_join, rows_of
from lineloom.session import materialize


def parse_instruments(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Telescope, spectrograph, detector, setup and confidence columns from the raw text."""
    out = df.withColumns({"telescope": regex_cascade(raw, R.TELESCOPE_RULES),
                          "spectrograph": regex_cascade(raw, R.SPECTROGRAPH_RULES),
                          "detector": regex_cascade(raw, R.DETECTOR_RULES)})
    out = out.withColumn("telescope", fill_from_map("telescope", "spectrograph", R.IMPLIED_TELESCOPE))
    sure = R.INTEGRATED_SETUPS + list(R.IMPLIED_TELESCOPE)
    return (out.withColumn("confidence", match_confidence("telescope", "spectrograph", "detector", sure))
            .withColumn("instrument_setup", join_parts("telescope", "spectrograph", "detector")))


def build_lookup(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One parsed row per distinct raw text, with its row count; the rules never see repeats."""
    values = df.filter(F.col(raw).isNotNull()).groupBy(raw).agg(F.count("*").alias("n_rows"))
    return parse_instruments(values, raw)


def apply_lookup(df: DataFrame, lookup: DataFrame, raw: str = "raw") -> DataFrame:
    """Parsed columns on every row; texts without an entry stay NULL."""
    return lookup_join(df, lookup.drop("n_rows"), [raw], "left")


def lookup_stats(lookup: DataFrame) -> DataFrame:
    """Setups and rows per confidence; coverage and distinct count per component: long rows."""
    conf = lookup.groupBy(F.col("confidence").alias("name")).agg(F.count("*").alias("n_setups"), F.sum("n_rows").alias("n_rows"))
    conf = conf.select(F.lit("confidence").alias("section"), "name", "n_setups", "n_rows")
    parts = ["telescope", "spectrograph", "detector"]
    one = lookup.agg(*[F.count(c).alias(f"s_{c}") for c in parts],
                     *[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n_rows"))), F.lit(0)).alias(f"r_{c}") for c in parts],
                     *[F.count_distinct(c).alias(f"d_{c}") for c in parts])
    rows = [("covered", c, F.col(f"s_{c}"), F.col(f"r_{c}")) for c in parts]
    rows += [("distinct", c, F.col(f"d_{c}"), F.col(f"r_{c}")) for c in parts]
    table = rows_of(["section", "name", "n_setups", "n_rows"], rows)
    return conf.unionByName(one.select(F.inline(table)))


def lookup_listing(lookup: DataFrame, levels: tuple[str, ...] = ("low", "medium"), raw: str = "raw") -> DataFrame:
    """Setups of the given confidences, for review: text, parts, confidence and rows."""
    return lookup.filter(F.col("confidence").isin(*levels)).select(raw, "telescope", "spectrograph", "detector", "confidence", "n_rows")


def name_centroids(df: DataFrame, name: str = "name", x: str = "ra", y: str = "dec") -> DataFrame:
    """Median position and rows per name; names without any position are left out."""
    g = group_stats(df.filter(F.col(name).isNotNull()), [name], [F.count("*").alias("n")], [(x, 0.5, "x"), (y, 0.5, "y")])
    return g.filter("x is not null and y is not null")


def canonical_names(centroids: DataFrame, components: DataFrame, name: str = "name") -> DataFrame:
    """(name, canonical, component, n, total): the member with most rows, ties to the first name."""
    c = centroids.join(components, name)
    best = c.groupBy("component").agg(
        F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias("canonical"),
        F.sum("n").alias("total"), F.count("*").alias("n_members"))
    return lookup_join(c, best, ["component"])


def name_texts(df: DataFrame, raw: str = "raw", name: str = "name") -> DataFrame:
    """Normalised name of each distinct raw text, written; the rules never see repeats."""
    return materialize(df.select(raw).filter(F.col(raw).isNotNull()).distinct().withColumn(name, normalize_name(raw)))


def merge_names(df: DataFrame, raw: str = "raw", x: str = "ra", y: str = "dec", radius: float = 0.01, texts: DataFrame | None = None) -> DataFrame:
    """Name map: every normalised name with a position and the canonical name of its group. ``texts``: the names of the raw texts,
    where the caller has them."""
    texts = name_texts(df, raw) if texts is None else texts
    base = materialize(lookup_join(df.select(raw, x, y), texts, [raw]).select("name", x, y))
    cent = materialize(name_centroids(base, "name", x, y))
    comp = connected_components(cent, radius_edges(cent, "name", "x", "y", radius), "name")
    return materialize(canonical_names(cent, comp))


def apply_canonical(df: DataFrame, mapping: DataFrame, name: str = "name", out: str = "star_name") -> DataFrame:
    """Canonical name on every row; unmapped names keep their normalised form."""
    m = mapping.select(F.col("name").alias(name), F.col("canonical").alias("_c"))
    return lookup_join(df, m, [name]).withColumn(out, F.coalesce("_c", name)).drop("_c")


def apply_texts(df: DataFrame, texts: DataFrame, mapping: DataFrame, raw: str = "raw", name: str = "name", out: str = "star_name") -> DataFrame:
    """Normalised and canonical name on every row by its raw text: one join, of a table of distinct texts."""
    return lookup_join(df, apply_canonical(texts, mapping, name, out).select(raw, name, out), [raw])


def variant_report(df: DataFrame, canonical: str = "star_name", raw: str = "raw", name: str = "name",
                   x: str = "ra", y: str = "dec") -> DataFrame:
    """Long report: per canonical name its rows and median position, with one row per raw variant."""
    df = materialize(df.select(*dict.fromkeys([canonical, raw, name, x, y])))
    n = group_stats(df, [canonical], [F.count("*").alias("n_rows"), F.count_distinct(raw).alias("n_raw_variants"),
                                      F.count_distinct(name).alias("n_names")], [(x, 0.5, "med_ra"), (y, 0.5, "med_dec")])
    n = n.withColumns({c: F.round(c, 6) for c in ("med_ra", "med_dec")})
    variants = df.groupBy(canonical, raw, name).agg(F.count("*").alias("n_variant"))
    return lookup_join(variants, n, [canonical])


def top_lookup(lookup: DataFrame, k: int = 20) -> DataFrame:
    return lookup.orderBy(F.desc("n_rows"), F.asc("raw")).limit(k)
