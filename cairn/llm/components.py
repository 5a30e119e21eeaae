"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables


#: Hubs are nodes of more than a ``HUBS``-th of all link ends, so there are never more than ``HUBS`` of them.
HUBS = 10_000
#: Fewer ends are no hub, whatever the share.
LEAST_HUB = 500


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: int, ends: str = "ends") -> DataFrame:
    """Inner join of ``rows`` with a table that has each of their keys once and in ``ends`` how many of the ``count`` rows have it.

    Rows of hot keys aren't shuffled: the table's rows for them, at most ``HUBS`` (or ``count / LEAST_HUB``, if that is less), are broadcast.
    """
    most = max(LEAST_HUB, count // HUBS)
    hubs = F.broadcast(table.filter(F.col(ends) > most).drop(ends))
    few = table.filter(F.col(ends) <= most).drop(ends)
    return rows.join(hubs.select(*keys), keys, "left_anti").join(few, keys).unionByName(rows.join(hubs, keys))


def _large_star(links: DataFrame, count: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("ends"))
    return spread_join(both, least, ["u"], 2 * count).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, count: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("ends"))
    moved = spread_join(down, least, ["u"], count).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple[int, int | None]:
    r = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r.n, r.x


#: Links of one file of a round; a table of few links is few files, whatever the number of shuffle partitions.
FILE_LINKS = 200_000


def _sized(links: DataFrame, count: int) -> DataFrame:
    return links.coalesce(1 + count // FILE_LINKS)


def components(links: DataFrame, work: WorkTables, name: str) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches, itself included.

    ``links`` has long columns ``u`` and ``v``. The number of rounds grows with the logarithm of the
    graph's size; each round's links are written to the shared folder, so lineage stays short.
    """
    current = work.keep(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, k = _state(current), 0
    while state[0]:
        large = work.keep(_sized(_large_star(current, state[0]).distinct(), state[0]), f"{name}-{k}-large")
        after = work.keep(_sized(_small_star(large, state[0]).distinct(), state[0]), f"{name}-{k + 1}")
        work.drop(f"{name}-{k}", f"{name}-{k}-large")
        k += 1
        current, before, state = after, state, _state(after)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
