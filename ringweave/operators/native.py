"""Jobs and rings as columns.

A ring's key is the entering row's own key, so a ring needs no generated ids, survives retries and
shuffles by a column that may be bucketed already. Groups are folded with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_map(df: DataFrame, values: Column, name: str, *, keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """One row per element of an array; null elements are dropped, null and empty arrays give no rows."""
    made = F.filter(values, lambda x: x.isNotNull())
    if position is None:
        return df.select(*keep, F.explode(made).alias(name))
    return df.select(*keep, F.posexplode(made).alias(position, name))


def route(df: DataFrame, targets: Mapping[str, tuple[Column, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Each row goes through every branch whose condition it meets; the branches' rows are one bag.

    For branches that are whole plans: each reads df for itself. Branches that are columns go by routed().
    """
    out = None
    for condition, branch in targets.values():
        made = branch(df.where(condition))
        out = made if out is None else out.unionByName(made)
    return out


def routed(df: DataFrame, targets: Mapping[str, tuple[Column, Mapping[str, Column]]], *, keep: Sequence[str] = (), target: str = "target") -> DataFrame:
    """Each row gives a row for every target whose condition it meets, with that target's columns; df is read once."""
    made = [F.when(condition, F.struct(F.lit(name).alias(target), *[c.alias(n) for n, c in columns.items()])) for name, (condition, columns) in targets.items()]
    names = next(iter(targets.values()))[1]
    sent = df.select(*keep, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("_sent"))
    return sent.select(*keep, *[F.col(f"_sent.{n}") for n in (target, *names)])


def entries(df: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The rings that open: one per entering row."""
    return df.select(*keys, *keep)


def ring_reduce(rings: DataFrame, body: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], initial: Mapping[str, Column], *, never_empty: bool = False) -> DataFrame:
    """One row per ring with its store. A ring whose body gave nothing has the initial store.

    never_empty: the body gives at least a row per ring, so the join with the rings is left out.
    """
    stores = body.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    if never_empty:
        return stores
    return rings.join(stores, list(keys), "left").select(*rings.columns, *[F.coalesce(F.col(n), initial[n]).alias(n) for n in aggregates])


def global_reduce(df: DataFrame, aggregates: Mapping[str, Column], initial: Mapping[str, Column] | None = None, *, always: bool = False) -> DataFrame:
    """The ring over all rows. Without rows it emits nothing or, with always, its initial store."""
    out = df.agg(*[c.alias(n) for n, c in aggregates.items()], F.count("*").alias("_rows"))
    initial = initial or {}
    if not always:
        out = out.where("_rows > 0")
    return out.select(*[F.when(F.col("_rows") > 0, F.col(n)).otherwise(initial[n]).alias(n) if n in initial else F.col(n) for n in aggregates])


def map_ordered(df: DataFrame, index: str, **columns: Column) -> DataFrame:
    """Maps rows and restores the order of their index."""
    return df.select(index, *[c.alias(n) for n, c in columns.items()]).orderBy(index)


def tagged(df: DataFrame, kind: Column, cases: Mapping[str, Column], name: str) -> DataFrame:
    """Dispatch by a row's kind, as of a class hierarchy; a kind that no case names, or null, fails the query."""
    out = F
    for case, value in cases.items():
        out = out.when(kind == case, value)
    return df.withColumn(name, out.otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(kind.cast("string"), F.lit("null"))))))
