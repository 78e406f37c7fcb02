"""Registered profiling queries (D1-D10, U4, K2, K3) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import profile as PR
from tessera.operators import profile_states as PS
from tessera.sources import tables as TB

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3-D8 + D10: numeric profile of lineitem, one block per return flag."""
    li = TB.table(spark, sf_dir, "lineitem")
    return PR.profile_numeric(li, ["l_returnflag"], LINEITEM_NUMERIC)


def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 + K2: cardinality and top-10 values of the categorical order columns."""
    o = TB.table(spark, sf_dir, "orders")
    return PR.profile_categorical(o, [], ["o_orderstatus", "o_orderpriority"])


def profile_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + U4: overview and duplicate rows of (text, lang) per document source."""
    d = TB.table(spark, sf_dir, "documents").select("source", "text", "lang")
    return PR.profile_overview(d, ["source"])


def profile_categorical_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 + K2 + P13: every categorical column of orders, as its schema tells them."""
    return PR.profile_categorical(TB.table(spark, sf_dir, "orders"), [])


def profile_overview_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + U4: overview and duplicate rows over all columns of documents, per source."""
    return PR.profile_overview(TB.table(spark, sf_dir, "documents"), ["source"])


def nullity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 + K3: null counts of label columns after a left join, per source."""
    d = TB.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = TB.table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left").select("source", "lang", "quality", "toxic")
    return PR.nullity(j, ["source"])


LEVEL_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]
LEVEL_NUMERIC = [c for c in LINEITEM_NUMERIC if c not in LEVEL_KEYS]


def profile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2-D5, D7, D8 + S9: counts, extremes and moments of lineitem at four levels, the upper ones merged from the states below."""
    li = TB.table(spark, sf_dir, "lineitem")
    states = PS.all_levels(PS.numeric_states(li, LEVEL_KEYS, LEVEL_NUMERIC, sketches=False), LEVEL_KEYS, PS.merge_numeric)
    return PS.numeric_moments(states, ["level", *LEVEL_KEYS])


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collected report over all columns of orders by status, then priority: sketched percentiles, distinct counts and top values."""
    o, keys = TB.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]
    num = PS.numeric_report(PS.all_levels(PS.numeric_states(o, keys), keys, PS.merge_numeric), ["level", *keys])
    text = PS.text_report(PS.all_levels(PS.text_states(o, keys), keys, PS.merge_text), ["level", *keys])
    return num.unionByName(text, allowMissingColumns=True)
