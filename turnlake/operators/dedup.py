"""Exact removal of repeats; the greedy near-copy passes are in folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.ranking import first_per_key
from turnlake.operators.shared import durable, fresh, hot_join


def exact(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each MD5 of the keys."""
    return first_per_key(df.withColumn("_fp", F.md5(F.concat_ws("||", *keys))), ["_fp"], order).drop("_fp")


def limit_reuse(df: DataFrame, unit: str, order: list, most: int = 2) -> DataFrame:
    """Rows of one unit each: the first most of a unit; rows without a unit stay. Only the first rows of a unit
    in each task travel (a limit of the window's groups), and rows without one not at all."""
    n = F.row_number().over(Window.partitionBy(unit).orderBy(*order))
    first = df.where(F.col(unit).isNotNull()).withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
    return first.unionByName(df.where(F.col(unit).isNull()))


#: Rounds in which units decide alone, before what is left is folded by components.
UNIT_ROUNDS = 3
#: Rows of a component that one task folds; larger ones go on in rounds.
UNIT_ROWS = 1_000_000


def capped_rows(rows: DataFrame, id_col: str, order: list[str], most: int = 2) -> DataFrame:
    """Ids that stay of rows (id_col, group, order columns, units: array) when each unit may be in most rows that
    stay, taken in order (group by group): a row stays if none of its units is used up. Rows of different
    groups are apart; rows without units all stay.

    In a round, a row among the first free uses of each of its units stays for certain, and a row with a unit
    used up does not; what is left after UNIT_ROUNDS is folded in order, a component of rows that share units
    in one task; components above UNIT_ROWS go on in rounds, which always settle their first row. Only ids,
    units and order travel, of a unit its first rows in each task."""
    from turnlake.operators.folds import capped_use
    from turnlake.operators.graph import components

    place = F.struct(*order, id_col)
    base = rows.select(F.struct("group", F.col(id_col)).alias("i"), "group", place.alias("at"), F.array_distinct("units").alias("units"))
    kept = base.where("coalesce(size(units), 0) <= 0").select("i")
    left = durable(base.where("size(units) > 0"))
    used, folds, rounds = None, [], 0
    while not left.isEmpty():
        wanted = left.select("i", "at", F.size("units").alias("n"), F.explode("units").alias("unit"), "group").withColumn("u", F.struct("group", "unit"))
        ranked = wanted.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("at"))).where(F.col("k") <= most)
        free = ranked if used is None else ranked.join(used, "u", "left").where(F.col("k") + F.coalesce("uses", F.lit(0)) <= most).drop("uses")
        sure = durable(free.groupBy("i").agg(F.count("*").alias("hits"), F.max("n").alias("n"), F.collect_list("u").alias("us")).where("hits = n"))
        more = sure.select(F.explode("us").alias("u")).groupBy("u").agg(F.count("*").alias("uses"))
        kept = kept.unionByName(sure.select("i"))
        used = durable((more if used is None else used.unionByName(more)).groupBy("u").agg(F.sum("uses").alias("uses")))
        # The other rows of units that are used up drop out; a unit of many rows meets a broadcast table.
        sizes = wanted.groupBy("u").agg(F.count("*").alias("rows"))
        full = used.where(F.col("uses") >= most).select("u", F.lit(True).alias("full")).join(sizes, "u")
        out = hot_join(wanted.select("i", "u"), full, "u", "rows", wanted.count()).where("full").select("i").distinct()
        left = durable(left.join(sure.select("i"), "i", "left_anti").join(out, "i", "left_anti"))
        rounds += 1
        if rounds % UNIT_ROUNDS == 0 and not left.isEmpty():
            done, left = _by_component(left, used, most, components, capped_use)
            folds.append(done)
    for done in folds:
        kept = kept.unionByName(done)
    return kept.select(F.col(f"i.{id_col}").alias(id_col), F.col("i.group").alias("group"))


def _by_component(left: DataFrame, used: DataFrame, most: int, components, capped_use) -> tuple[DataFrame, DataFrame]:
    """Rows that stay of all components up to UNIT_ROWS, and the rows of larger ones. Uses so far count first."""
    import pandas as pd

    links = left.select(F.to_json("i").alias("row"), F.explode("units").alias("unit"), "group").select(F.concat(F.lit("r"), "row").alias("u"), F.concat(F.lit("u"), F.to_json(F.struct("group", "unit"))).alias("v"))
    roots = durable(components(links))
    tagged = left.withColumn("node", F.concat(F.lit("r"), F.to_json("i"))).join(roots, "node").drop("node")
    sizes = durable(tagged.groupBy("root").agg(F.count("*").alias("n_rows")))
    small = tagged.join(sizes.where(F.col("n_rows") <= UNIT_ROWS).select("root"), "root", "left_semi")
    uses = small.select("root", F.explode("units").alias("unit"), "group").distinct().withColumn("u", F.struct("group", "unit")).join(used, "u").select("root", "unit", "uses")

    def fold(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        # Uses before these rows stand for rows that stay, ahead of all.
        ahead = [(None, [u]) for u, k in zip(before.unit, before.uses, strict=True) for _ in range(int(k))]
        stay = capped_use([*ahead, *((i, list(us)) for i, us in zip(rows.j, rows.units, strict=True))], most)
        return pd.DataFrame({"j": [i for i in stay if i is not None]})

    ranked = durable(small.withColumn("j", F.to_json("i")).withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("at"))).select("root", "j", "n", "units", "i"))
    stay = fresh(ranked.select("root", "j", "n", "units")).groupBy("root").cogroup(fresh(uses).groupBy("root")).applyInPandas(fold, "j string")
    done = durable(ranked.join(stay, "j", "left_semi").select("i"))
    large = durable(tagged.join(sizes.where(F.col("n_rows") > UNIT_ROWS).select("root"), "root", "left_semi").drop("root"))
    return done, large


def unique_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of the first."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def representatives(samples: DataFrame, group: str, aliases: dict[str, list[str]], order: list, case: str) -> DataFrame:
    """The first sample whose group matches each class's aliases; a case stands for its first class."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("label"), F.array(*map(F.lit, a)).alias("a")) for i, (c, a) in enumerate(aliases.items())))
    hits = samples.withColumn("_t", F.explode(table)).where(F.exists("_t.a", lambda a: F.contains(F.col(group), a)))
    firsts = first_per_key(hits.withColumn("label", F.col("_t.label")).withColumn("_i", F.col("_t.i")).drop("_t"), ["label"], order)
    return first_per_key(firsts, [case], ["_i"]).drop("_i")


def overlap_representatives(samples: DataFrame, overlap: str, targets: list[float], order: list, prefix: str) -> DataFrame:
    """The first sample of each target overlap, labelled with it; a target without a sample has no row."""
    near = samples.where(F.col(overlap).isin(targets))
    return first_per_key(near, [overlap], order).withColumn("label", F.concat(F.lit(prefix), F.col(overlap).cast("int").cast("string")))
