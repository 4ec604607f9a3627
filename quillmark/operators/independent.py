"""Greedy selection as Spark jobs: of ordered rows, each that shares no key with one kept before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

_OWN = "__greedy_"


def greedy(rows: DataFrame, keys: dict[str, Column], order: list[Column], lone: str | None = None) -> DataFrame:
    """The rows that a loop in `order` would keep, which takes a row unless a row it took before has one of its keys.

    That is the lexicographically first independent set of the graph in which rows
    that share a key are neighbours. It is found by rounds: an undecided row that
    comes first among the undecided of each of its keys is taken, and those that
    share a key with it go. Rows with all keys alike are one from the start, and a
    round's groups are minima, combined before the shuffle, so that a common key is
    no task's burden; rounds are as many as the longest chain of rows each waiting for
    the one before, few unless keys are chained on purpose. A null key is a key like
    any other. Rows that tie in `order` are taken as Spark has them; order should be total.

    lone names a key that few rows share: of the rows that share it with none and agree
    in all others, only the first can be taken, whatever else is, and so the rounds
    see no more of them.
    """
    names = [f"{_OWN}k{i}" for i in range(len(keys))]
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    rows = rows.withColumns(dict(zip(names, keys.values())) | {f"{_OWN}o": place})
    firsts = rows.groupBy(*names).agg(F.min(f"{_OWN}o").alias(f"{_OWN}o"))
    if lone is not None:
        firsts = _first_of_lone(settled(firsts, "greedy"), names[list(keys).index(lone)], names)
    left = settled(firsts, "greedy")
    taken: DataFrame | None = None
    while not left.isEmpty():
        least = left
        for name in names:
            first = left.groupBy(F.col(name).alias("k")).agg(F.min(f"{_OWN}o").alias(f"{name}_first"))
            least = least.join(first, F.col(name).eqNullSafe(F.col("k"))).drop("k")
        now = settled(least.where(" and ".join(f"{_OWN}o = {n}_first" for n in names)).select(*names, f"{_OWN}o"), "greedy")
        taken = now if taken is None else taken.unionByName(now)
        for name in names:
            gone = now.select(F.col(name).alias("k")).distinct()
            left = left.join(gone, F.col(name).eqNullSafe(F.col("k")), "left_anti")
        left = settled(left, "greedy")
    if taken is None:
        return rows.where("false").drop(*names, f"{_OWN}o")
    return rows.join(taken.select(f"{_OWN}o"), f"{_OWN}o", "left_semi").drop(*names, f"{_OWN}o")


def _first_of_lone(rows: DataFrame, own: str, names: list[str]) -> DataFrame:
    """rows but those that share no key `own` with another and all other keys with an earlier one of that kind."""
    others, columns = [n for n in names if n != own], [*names, f"{_OWN}o"]
    counted = settled(rows.groupBy(own).agg(F.count("*").alias("n"), F.first(F.struct(*others, f"{_OWN}o")).alias("r")), "greedy")
    single = counted.where("n = 1").select(own, "r.*")
    single = single.groupBy(*others).agg(F.min(F.struct(f"{_OWN}o", own)).alias("r")).select(*others, "r.*")
    many = counted.where("n > 1").select(F.col(own).alias("k"))
    return rows.join(many, F.col(own).eqNullSafe(F.col("k")), "left_semi").select(*columns).unionByName(single.select(*columns))
