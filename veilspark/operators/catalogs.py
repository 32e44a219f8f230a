"""Catalogs as tables: many of them composed at once, one for each tenant, by grouping.

A rule of a later layer overrides an earlier one of its id in place, and within a layer the last one wins, as `catalog.compose`
does for one catalog on the driver. Groups hold an id's few layers only, so neither a large tenant nor a common id gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.catalog import LAYERS


def _name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LAYERS)), rank), F.lit(""))


def composed(rules: DataFrame, disabled: DataFrame | None = None, by: Sequence[str] = (), keep: Sequence[str] = ("regex",)) -> DataFrame:
    """One row for each id: by, rule_id, keep, source, overridden_from ("" if nothing was), disabled, and first (where its earliest rule stands: findings are applied in this order).

    rules: by, layer, place (in its layer), rule_id, keep; rows of unknown layers are left out. disabled: by, rule_id, in any number.
    """
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")) - 1
    ranked = rules.withColumn("_rank", rank.cast("int")).where("_rank >= 0")
    at = F.struct("_rank", "place", *keep)
    found = ranked.groupBy(*by, "rule_id").agg(F.max(at).alias("_win"), F.min(F.struct("_rank", "place")).alias("first"), F.collect_set("_rank").alias("_ranks"))
    before = F.array_max(F.filter("_ranks", lambda r: r < F.col("_win._rank")))
    out = found.select(*by, "rule_id", *[F.col(f"_win.{c}").alias(c) for c in keep], _name(F.col("_win._rank")).alias("source"), F.coalesce(_name(before), F.lit("")).alias("overridden_from"), "first", F.col("_win._rank").alias("_rank"))
    if disabled is None:
        return out.withColumn("disabled", F.lit(False))
    off = disabled.select(*by, "rule_id").distinct().withColumn("_off", F.lit(True))
    return out.join(off, [*by, "rule_id"], "left").withColumn("disabled", F.coalesce("_off", F.lit(False))).drop("_off")


def effective(made: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ("regex",)) -> DataFrame:
    """The rules in force: by, place (from 1, in the order that findings are applied), rule_id, keep, source, overridden_from. made: of composed()."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("first", "rule_id"))
    return made.where(~F.col("disabled")).select(*by, place.cast("long").alias("place"), "rule_id", *keep, "source", "overridden_from")


def listing(made: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, place (from 1, by layer and id), source, rule_id, state (active, disabled, or overrides some layer)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_rank", "rule_id"))
    state = F.when(F.col("disabled"), "disabled").when(F.col("overridden_from") != "", F.concat(F.lit("overrides "), F.col("overridden_from"))).otherwise("active")
    return made.select(*by, place.cast("long").alias("place"), "source", "rule_id", state.alias("state"))


def project_warnings(made: DataFrame, skips: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, rules (ids that the project layer overrides, in order), count (of these and of skip patterns) for catalogs that a project weakens. skips: by, and a row for each pattern."""
    ids = made.where((F.col("source") == "project") & (F.col("overridden_from") != "")).groupBy(*by).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    n = skips.groupBy(*by).agg(F.count("*").alias("_n"))
    none = F.array().cast("array<string>")
    both = ids.join(n, list(by), "full")
    return both.select(*by, F.coalesce("rules", none).alias("rules"), (F.size(F.coalesce("rules", none)) + F.coalesce("_n", F.lit(0))).alias("count"))
