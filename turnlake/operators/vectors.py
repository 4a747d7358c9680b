"""Cleaning of labelled speaker vectors: purification of centroids, and propagation of labels to the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.operators.shared import durable, fresh, same


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def centroids(members: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """keys, label, centroid (the mean vector), n: sums of places, added up in every task first."""
    parts = members.select(*keys, "label", F.posexplode(vector).alias("__i", "__x")).groupBy(*keys, "label", "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.count("*").alias("__n"))
    return parts.groupBy(*keys, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias("centroid"), F.max("__n").alias("n"))


def purify(vectors: DataFrame, keys: list[str], least: float, id_col: str = "vec_id", vector: str = "embedding", rounds: int = 50) -> DataFrame:
    """Vectors with member (whether the vector stays with its label) and dropped_in (the round that dropped it, else
    null). A round forms centroids of the members and drops those with a cosine below least to their own, until
    none drops; a label may lose all. Rounds are bounded: going on beyond them is an error, not a result. Null
    labels are no members; vectors without length have no cosine and are dropped."""
    state = durable(vectors.select(*keys, id_col, "label", vector, F.col("label").isNotNull().alias("member"), F.lit(None).cast("int").alias("dropped_in")))
    for k in range(1, rounds + 1):
        middle = centroids(state.where("member"), keys, vector).withColumnsRenamed({c: f"__c_{c}" for c in [*keys, "label", "centroid", "n"]})
        met = state.join(middle, same([*keys, "label"], right="__c_") & F.col("member"), "left")
        out = F.col("member") & (F.coalesce(cosine(F.col(vector), F.col("__c_centroid")), F.lit(-2.0)) < least)
        state = durable(met.select(*keys, id_col, "label", vector, (F.col("member") & ~out).alias("member"), F.when(out, F.lit(k)).otherwise(F.col("dropped_in")).alias("dropped_in")))
        if state.where(F.col("dropped_in") == k).isEmpty():
            return state
    raise RuntimeError(f"members still drop after {rounds} rounds")


#: Members, and vectors without a label, that one task compares at a time.
BLOCK_ROWS = 4096


def propagate(state: DataFrame, keys: list[str], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """keys, id, assigned, cosine of purify()'s vectors: members keep their label, the others take that of the member
    of their recording (keys) with the largest cosine; of equal ones the least id; null if there is no member.
    Both sides are dealt into blocks of BLOCK_ROWS, so that a task holds one block of each and a recording of
    any size is many tasks."""
    sizes = state.groupBy(*keys).agg(F.ceil(F.count(F.when(F.col("member"), 1)) / BLOCK_ROWS).cast("int").alias("__mb"), F.ceil(F.count(F.when(~F.col("member"), 1)) / BLOCK_ROWS).cast("int").alias("__rb"))
    sized = state.join(sizes.withColumnsRenamed({k: f"__k_{k}" for k in keys}), same(keys, right="__k_")).drop(*(f"__k_{k}" for k in keys))
    deal = lambda n: F.pmod(F.xxhash64(id_col), F.greatest(F.lit(1), F.col(n))).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n)) - 1))
    hold = sized.where("member").withColumn("__m", deal("__mb")).withColumn("__r", across("__rb")).select(*keys, "__m", "__r", id_col, "label", vector)
    rest = sized.where(~F.col("member")).withColumn("__r", deal("__rb")).withColumn("__m", across("__mb")).select(*keys, "__m", "__r", id_col, vector)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, id_col]) + f", near {kinds[id_col]}, label {kinds['label']}, cosine double"

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.array(rows.tolist(), np.float64)
        size = np.sqrt((m * m).sum(1, keepdims=True))
        return np.where(size > 0, m / np.where(size > 0, size, 1), np.nan)

    def nearest(key: tuple, members: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = {k: [v] * len(others) for k, v in zip(keys, key, strict=False)} | {id_col: others[id_col].tolist()}
        if not len(others) or not len(members):
            return pd.DataFrame({**out, "near": [None] * len(others), "label": [None] * len(others), "cosine": [np.nan] * len(others)})
        members = members.sort_values(id_col)
        close = np.nan_to_num(unit(others[vector]) @ unit(members[vector]).T, nan=-2.0)
        best = close.argmax(1)  # the first of equal ones, so the least id
        score = close[np.arange(len(others)), best]
        return pd.DataFrame({**out, "near": members[id_col].to_numpy()[best], "label": members["label"].to_numpy()[best], "cosine": score})

    by = [*keys, "__m", "__r"]
    found = fresh(rest).groupBy(*by).cogroup(fresh(hold).groupBy(*by)).applyInPandas(lambda key, o, m: nearest(key, m, o), schema)
    known = found.where("near is not null and cosine > -2")
    best = known.groupBy(*keys, id_col).agg(F.min_by(F.struct("label", "cosine"), F.struct(-F.col("cosine"), "near")).alias("b")).withColumnsRenamed({c: f"__b_{c}" for c in [*keys, id_col]})
    left = state.where(~F.col("member")).select(*keys, id_col).join(best, same([*keys, id_col], right="__b_"), "left")
    own = state.where("member").select(*keys, id_col, F.col("label").alias("assigned"), F.lit(None).cast("double").alias("cosine"))
    return own.unionByName(left.select(*keys, id_col, F.col("b.label").alias("assigned"), F.col("b.cosine").alias("cosine")))
