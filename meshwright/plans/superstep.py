"""The loop driver of the vertex programs.

A vertex program keeps one state row per vertex. A superstep sends messages
along the edges of active vertices, combines them per receiver and applies
them. Several supersteps are chained into one plan, with one shuffle each (the
messages; edges and state stay where they are), before the state is cut to a
checkpoint and one small job asks whether anything is still active.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .recovery import cut

#: Supersteps to a plan. A step names the state twice, so a longer chain doubles what the optimiser sees with each step.
CHAIN = 2


def metrics_frame(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    """(step, frontier, seconds) of a finished run: the vertices that a step made active, and the seconds of the plan that it was part of, spread over its steps."""
    return spark.createDataFrame([(m["step"], m["frontier"], m["seconds"]) for m in metrics], "step int, frontier long, seconds double")


#: Hops to a plan of ``hops``, at most; it takes fewer where they could meet more than this share of the vertices again.
MOST_HOPS, AGAIN = 8, 4


def hops(n: int, frontier: int) -> int:
    """How many hops a plan takes from a frontier.

    Within a plan nothing tells a hop which vertices were reached before, so a small frontier's neighbourhood is walked
    again up to so many times; it saves as many checkpoints and jobs. A large frontier goes two hops at a time.
    """
    return max(2, min(MOST_HOPS, n // (AGAIN * max(1, frontier))))


def spread(start: DataFrame, edges: DataFrame, count: int, send: Callable[[int], dict[str, tuple[Column, Callable[[Column], Column]]]]) -> DataFrame:
    """The rows (v, ...) that ``start`` becomes in ``count`` hops over ``edges`` (src, dst, far).

    ``far`` is 1 for an edge and 0 for each vertex's loop to itself, over which a row stays where it is. ``send(i)`` gives
    hop i's columns: what goes over an edge, by its ``far``, and how what arrives is combined. Edges are dealt by src and
    results by v, so a hop shuffles its combined messages once and names the last hop's rows once.
    """
    rows = start
    for i in range(1, count + 1):
        columns = send(i)
        sent = rows.withColumnRenamed("v", "_v").join(edges, F.col("_v") == F.col("src"))
        sent = sent.select(F.col("dst").alias("v"), *[x.alias(c) for c, (x, _) in columns.items()])
        rows = sent.groupBy("v").agg(*[combine(F.col(c)).alias(c) for c, (_, combine) in columns.items()])
    return rows


def superstep(state: DataFrame, edges: DataFrame, active: Column, message: Column, combine: Callable[[Column], Column], apply: dict[str, Column]) -> DataFrame:
    """One step: ``message`` (over state columns) goes from active v along src -> dst; ``apply`` gives the new state columns, over the old ones and ``msg`` (null where none came)."""
    sent = state.filter(active).select(F.col("v").alias("_v"), message.alias("_m")).join(edges, F.col("_v") == F.col("src"))
    got = sent.groupBy(F.col("dst").alias("_to")).agg(combine(F.col("_m")).alias("msg"))
    after = state.join(got, F.col("v") == F.col("_to"), "left")
    kept = [c for c in state.columns if c not in apply]
    return after.select(*kept, *[x.alias(c) for c, x in apply.items()])


def run(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], live: Callable[[int], Column], most: int | None = None, chain: int = CHAIN, metrics: list[dict] | None = None) -> DataFrame:
    """Steps ``state`` (step numbers from 1) until no row meets ``live`` of the last step, or ``most`` steps are done.

    ``metrics``, if given, gets a row for each chained plan: its last step, its seconds, and how many rows are still live.
    """
    state = cut(state)
    done = 0
    while most is None or done < most:
        began = time.perf_counter()
        n = chain if most is None else min(chain, most - done)
        for i in range(1, n + 1):
            state = step(state, done + i)
        state = cut(state)
        done += n
        left = state.filter(live(done))
        left = left.limit(1).count() if metrics is None else left.count()
        if metrics is not None:
            metrics.append({"step": done, "frontier": left, "seconds": time.perf_counter() - began})
        if not left:
            break
    return state
