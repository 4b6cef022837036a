"""Control and mock samples: which they are, leaving them out, and what they tell of contamination."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import kernels
from quadrat.operators.community import UNCLASSIFIED, numbered

# Words of a metadata cell that mark a negative control, and a mock community.
NEGATIVE = ["negative", "neg", "blank", "ntc", "extraction blank", "pcr blank", "kit blank", "negative control", "nc", "water"]
MOCK = ["mock", "positive", "positive control", "pc", "zymo", "standard", "mock community"]
# Columns that may hold such a word, the first filled one counts; words that leave a sample out of group tests.
KIND_COLUMNS = ["control", "sample_type", "type"]
LEFT_OUT = ["negative", "blank", "ntc", "neg", "mock", "positive"]


def kind_word(attrs: str | Column = "attrs") -> Column:
    """The first filled cell of the columns that tell a sample's kind, in lower case; names of columns in any case."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    folded = F.transform(F.map_entries(a), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.lower(F.trim(e["value"])).alias("v")))
    pick = lambda name: F.get(F.transform(F.filter(folded, lambda e: (e["k"] == name) & (e["v"] != "")), lambda e: e["v"]), F.lit(0))
    return F.coalesce(*(pick(c) for c in KIND_COLUMNS), F.lit(""))


def control_kinds(samples: DataFrame, negatives: list[str] | None = None, mocks: list[str] | None = None) -> DataFrame:
    """(sample, kind): negative or mock, by the given names first, then by the words of the metadata. samples: (sample, attrs)."""
    word = kind_word()
    kind = F.when(F.col("sample").isin(negatives or []), "negative").when(F.col("sample").isin(mocks or []), "mock").when(word.isin(NEGATIVE), "negative").when(word.isin(MOCK), "mock")
    return samples.select("sample", kind.alias("kind")).where("kind IS NOT NULL")


def tested_groups(samples: DataFrame, group: str = "group") -> DataFrame:
    """(sample, grp): samples with a group that are no controls. samples: (sample, attrs)."""
    named = F.trim(F.coalesce(F.try_element_at("attrs", F.lit(group)), F.try_element_at("attrs", F.lit(group.capitalize())), F.lit("")))
    return samples.where(~kind_word().isin(LEFT_OUT)).select("sample", named.alias("grp")).where("grp <> ''")


def without(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows of all other samples."""
    return rows.join(samples.select("sample"), "sample", "left_anti")


def chosen_group_column(metadata: DataFrame, forced: str | None = None, chosen: str | None = None, key: str = "sample") -> str | None:
    """The column that groups samples: forced, else chosen, else one named group, else the first other with two filled values; None without one.

    A decision over the columns of a metadata table: one aggregate of one row.
    """
    columns = [c for c in metadata.columns if c != key]
    for name in (forced, chosen, next((c for c in columns if c in ("group", "Group")), None)):
        if name in columns:
            return name
    columns = [c for c in columns if c.lower() not in ("sampleid", "sample", "sample_id", "#sampleid", "description")]
    if not columns:
        return None
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    counts = metadata.agg(*(F.count_distinct(filled(c)).alias(str(i)) for i, c in enumerate(columns))).first()
    return next((c for i, c in enumerate(columns) if counts[i] >= 2), None)


def first_grouping(metadata: DataFrame, key: str = "sample") -> str | None:
    """The first column that groups: with two different values or more and fewer than there are rows; else the first column."""
    columns = [c for c in metadata.columns if c != key]
    if not columns:
        return None
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    s = metadata.agg(F.count("*").alias("n"), *(F.count_distinct(filled(c)).alias(str(i)) for i, c in enumerate(columns))).first()
    return next((c for i, c in enumerate(columns) if 2 <= s[str(i)] < s["n"]), columns[0])


def drawn_samples(samples: DataFrame, hidden: DataFrame, groups: DataFrame) -> DataFrame:
    """(sample, grp) of the samples that are shown: with a group, and not hidden."""
    return without(samples.select("sample").distinct(), hidden).join(groups.where("grp IS NOT NULL AND trim(grp) <> ''"), "sample")


def comparable(groups: DataFrame) -> DataFrame:
    """One row (samples, groups, comparable): whether group tests make sense: two groups or more, samples left over beside one for each, and a group of two."""
    s = groups.groupBy("grp").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("samples"), F.count("*").alias("groups"), F.max("m").alias("most"))
    return s.select("samples", "groups", F.coalesce((F.col("groups") >= 2) & (F.col("samples") > F.col("groups")) & (F.col("most") >= 2), F.lit(False)).alias("comparable"))


def contaminants(features: DataFrame, negatives: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(feature_id, in_samples, in_controls, p, contaminant): features that controls have more often than samples do.

    p: chance of as many samples with the feature or fewer, by the 2 x 2 table of presence: chi-square with one degree of
    freedom and continuity correction, one-sided; a feature of all samples or none has no p.
    """
    own = features.where("reads > 0").select("sample", "feature_id").distinct()
    marked = features.select("sample").distinct().join(negatives.select("sample", F.lit(1).alias("control")).distinct(), "sample", "left")
    n = marked.agg(F.count("control").alias("nc"), F.count(F.when(F.col("control").isNull(), 1)).alias("ns")).first()
    seen = own.join(marked, "sample").groupBy("feature_id").agg(F.count(F.when(F.col("control").isNull(), 1)).alias("in_samples"), F.count("control").alias("in_controls"))
    a, b = F.col("in_samples").cast("double"), F.col("in_controls").cast("double")
    c, d, total = n["ns"] - a, n["nc"] - b, float(n["ns"] + n["nc"])
    cross = a * d - b * c
    chi = F.try_divide(total * F.pow(F.greatest(F.abs(cross) - total / 2, F.lit(0.0)), 2), (a + b) * (c + d) * F.lit(float(n["ns"])) * F.lit(float(n["nc"])))

    @F.pandas_udf("double")
    def one_sided(x: pd.Series, sign: pd.Series) -> pd.Series:
        half = pd.Series(np.nan, index=x.index)
        half[x.notna()] = kernels.chi2_tail(x[x.notna()].to_numpy(), 1.0) / 2
        return half.where(sign < 0, 1 - half).astype("Float64")

    p = one_sided(chi, F.signum(cross))
    return seen.select("feature_id", "in_samples", "in_controls", F.when(chi.isNotNull(), p).alias("p")).withColumn("contaminant", F.coalesce(F.col("p") < threshold, F.lit(False)))


def mock_genera(shares: DataFrame, expected: DataFrame, families: DataFrame) -> DataFrame:
    """(sample, taxon, expected, observed, family_only, missing): each mock sample's expected genera.

    shares: (sample, taxon, pct) by genus. expected: (taxon, weight, family, names), names being synonyms. families: (sample, family, pct).
    A genus under a quarter of its expected per cent is missing, unless its family reaches that quarter.
    """
    total = expected.agg(F.sum("weight").alias("all"))
    want = expected.join(total).select("taxon", "family", (100 * F.col("weight") / F.col("all")).alias("expected"), F.array_distinct(F.concat(F.array("taxon"), F.coalesce("names", F.array().cast("array<string>")))).alias("names"))
    seen = shares.where(F.col("taxon") != UNCLASSIFIED).select("sample", F.col("taxon").alias("name"), "pct").join(want.select("taxon", F.explode("names").alias("name")), "name").groupBy("sample", "taxon").agg(F.sum("pct").alias("observed"))
    grid = shares.select("sample").distinct().join(want.drop("names"))
    low = F.col("observed") < 0.25 * F.col("expected")
    out = grid.join(seen, ["sample", "taxon"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0))).join(families.groupBy("sample", "family").agg(F.sum("pct").alias("f")), ["sample", "family"], "left")
    rescued = low & F.coalesce(F.col("f") >= 0.25 * F.col("expected"), F.lit(False))
    return out.select("sample", "taxon", "expected", "observed", rescued.alias("family_only"), (low & ~rescued).alias("missing"))


def mock_verdicts(shares: DataFrame, expected: DataFrame, families: DataFrame) -> DataFrame:
    """(sample, bray_curtis, other_pct, missing): the summary of ``mock_genera``."""
    g = mock_genera(shares, expected, families)
    known = g.groupBy("sample").agg(F.sum(F.abs(F.col("expected") - F.col("observed"))).alias("apart"), F.sum("observed").alias("seen"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("missing"), F.col("taxon")))), "|").alias("missing"))
    named = shares.where(F.col("taxon") != UNCLASSIFIED).groupBy("sample").agg(F.sum("pct").alias("named"))
    other = F.coalesce("named", F.lit(0.0)) - F.col("seen")
    return known.join(named, "sample", "left").select("sample", ((F.col("apart") + other) / 200).alias("bray_curtis"), other.alias("other_pct"), "missing")


def first_filled(names: list[str], columns: list[str]) -> Column:
    """The first of several column names that a table has and a row fills: for tables whose tools name their columns differently."""
    found = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in columns]
    return reduce(lambda a, b: F.coalesce(a, b), found) if found else F.lit(None).cast("string")


def ordered_levels(totals: DataFrame, other: str = "Other") -> DataFrame:
    """(place, taxon): from the largest total, the rest last. totals: (taxon, value)."""
    s = totals.groupBy("taxon").agg(F.sum("value").alias("value"))
    rest = F.coalesce(F.col("taxon") == other, F.lit(False))
    named = numbered(s.where(~rest), "value", "taxon", "place").select(F.col("place").cast("int").alias("place"), "taxon")
    last = named.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("place"))  # one row
    return named.unionByName(s.where(rest).select("taxon").crossJoin(F.broadcast(last)).select("place", "taxon"))
