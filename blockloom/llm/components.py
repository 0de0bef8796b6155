"""Connected components of an edge table, by hooking and contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import lookup, plain

#: Edges that a round works on in one task at most, some 1 MB. A shuffle of so few costs the driver more, a task a partition, than it saves.
FEW = 50_000


def _together(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``lookup`` of few rows that are in one partition on both sides, and in the result, so nothing is shuffled or broadcast."""
    return plain(rows, table.hint("merge"), key, spread).coalesce(1)


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) for every vertex of ``edges`` (a, b): comp is the smallest vertex that it reaches.

    Each round hooks every vertex to its smallest smaller neighbour, shortens
    the paths twice, and goes on with the edges between what is left; written
    tables carry the rounds. A round leaves only vertices that had no smaller
    neighbour, so a star takes one round, and a path of n in which ids come in no
    order a number that grows with the logarithm of n; one whose ids rise all
    along takes n / 4. A vertex to which many are hooked, or with many
    edges, is looked up by ``skew.lookup``, so no task gets all of them. A round
    of ``FEW`` edges at most is one task without a shuffle; what it does is the same.
    """
    given = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    first = scratch.keep(given, f"{name}-given")
    all_few = first.count() <= FEW
    first = first.coalesce(1) if all_few else scratch.keep(first.distinct(), f"{name}-edges")
    pairs, hooks = first, []
    while n := pairs.count():
        k, few = len(hooks), n <= FEW
        # Few edges are joined as they are; otherwise what is looked up by a key is a written table.
        held = (lambda df, _: df) if few else (lambda df, step: scratch.keep(df, f"{name}-{step}-{k}"))  # noqa: B023
        whole = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        find = _together if few else lookup
        pairs = whole(pairs)
        hook = held(pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "hook")
        for turn in range(2):
            above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hook = held(find(hook, above, "up", "id").select("id", F.coalesce("top", "up").alias("up")), f"hook{turn}")
        hooks.append(hook := scratch.keep(hook, f"{name}-hooks-{k}"))
        for end, other in (("a", "b"), ("b", "a")):
            pairs = held(find(pairs, whole(hook).select(F.col("id").alias(end), "up"), end, other).select(F.coalesce("up", end).alias(end), other), f"moved-{end}")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        pairs = scratch.keep(pairs, f"{name}-edges-{k}")
        scratch.drop(*(f"{name}-{x}-{k}" for x in ("hook", "hook0", "hook1", "moved-a", "moved-b")))
    labels = first.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("comp"))
    for k, hook in enumerate(hooks):
        up = hook.select(F.col("id").alias("comp"), "up")
        moved = _together(labels, up.coalesce(1), "comp", "id") if all_few else lookup(scratch.keep(labels, f"{name}-labels-{k}"), up, "comp", "id")
        labels = moved.select("id", F.coalesce("up", "comp").alias("comp"))
    return scratch.keep(labels, f"{name}-labels")
