"""Calls under a budget in three bounds: what a run may spend, what a month may spend, and what a call is expected to cost.

A call is made if what its run has spent, and what the month has spent, leave room for its expected cost; it is then
charged its real one.  A call without room is skipped, and a cheaper one after it may still be made.

1. Runs are replayed by themselves, each in its order, under their own bound.
2. Running sums over the months (no task holds a month) show the first call that the month has no room for.  Up to
   there the replay was right.
3. From there on a month has less room than one call may need, so few more are made.  Those that had room at that point
   are set aside once; each round takes the next NEXT of every month that still have room and replays them, until a month
   has no more.  A round makes at least one call, and mostly all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running
from ..sources.scratch import kept

UNBOUNDED = 1 << 60
NEXT = 4096


def by_run(calls: DataFrame, run_cap: int) -> DataFrame:
    """calls with ``fits``, ``charged`` and ``run_before``: each run's replay under its own bound."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, used = None, 0
        for f in frames:
            fits, before = [], []
            for key, projected, cost in zip(zip(f["month"].tolist(), f["run"].tolist()), f["projected"].tolist(), f["cost"].tolist()):
                if key != run:
                    run, used = key, 0
                before.append(used)
                fits.append(used + projected <= run_cap)
                used += cost if fits[-1] else 0
            yield f.assign(fits=fits, charged=f["cost"].where(pd.Series(fits, index=f.index), 0), run_before=before)

    ordered = calls.select("month", "run", "id", "t", "projected", "cost").repartition("month", "run").sortWithinPartitions("month", "run", "t", "id")
    return ordered.mapInPandas(replay, "month string, run string, id long, t long, projected long, cost long, fits boolean, charged long, run_before long")


def within_budgets(calls: DataFrame, run_cap: int = UNBOUNDED, month_cap: int = UNBOUNDED) -> DataFrame:
    """calls(month, run, id, t, projected, cost) -> (month, run, id, made, why, used): used is what the month has spent after the call, why says which bound a skipped one met (the run's first).

    A call that is expected to cost nothing is made however little is left of the month. Order is that of (t, id); an empty table gives no row.
    """
    spark = calls.sparkSession
    replayed = kept(running(by_run(calls, run_cap), "month", ["t", "id"], "charged", "month_before"), "budget")
    replayed = replayed.withColumn("key", F.struct("t", "id"))
    full = replayed.filter(F.col("fits") & (F.col("projected") > 0) & (F.col("month_before") + F.col("projected") > month_cap))
    # A row a month.
    ends = {r["month"]: (r["end"], r["spent"]) for r in full.groupBy("month").agg(F.min("key").alias("end"), F.min_by("month_before", "key").alias("spent")).collect()}
    kinds = "month string, end struct<t: long, id: long>, spent long, later array<struct<t: long, id: long, run: string, cost: long>>"

    def ended(found: dict) -> DataFrame:
        return spark.createDataFrame([(m, e, s, found.get(m, [])) for m, (e, s) in ends.items()], kinds)

    base = replayed.join(ended({}).select("month", "end"), "month").filter("key >= end").groupBy("month", "run").agg(F.min_by("run_before", "key").alias("run_base"))
    tail = kept(replayed.join(ended({}).select("month", "end"), "month").filter("key >= end").drop("end").join(base, ["month", "run"]), "budget-tail") if ends else None

    def judged(found: dict, calls: DataFrame) -> DataFrame:
        """Calls of the tail with what its months and runs have spent before each call, given the calls that were made since."""
        before = "filter(later, x -> x.t < t OR x.t = t AND x.id < id)"
        rows = calls.join(ended(found), "month")
        rows = rows.withColumn("month_spent", F.expr(f"spent + aggregate({before}, 0L, (a, x) -> a + x.cost)"))
        rows = rows.withColumn("run_spent", F.expr(f"run_base + aggregate(filter({before}, x -> x.run = run), 0L, (a, x) -> a + x.cost)"))
        run_fits, month_fits = F.col("run_spent") + F.col("projected") <= run_cap, (F.col("projected") == 0) | (F.col("month_spent") + F.col("projected") <= month_cap)
        return rows.withColumn("made", run_fits & month_fits).withColumn("why", F.when(~run_fits, "run").when(~month_fits, "month"))

    # Calls that cost something and that month and run had room for at the end of the replay: no other can be made later, as what is spent only grows.
    could = (F.col("cost") > 0) & (F.col("run_base") + F.col("projected") <= run_cap) & ((F.col("projected") == 0) | (F.col("spent") + F.col("projected") <= month_cap))
    possible = kept(tail.join(ended({}), "month").filter(could).select(tail.columns), "budget-possible") if ends else None
    found: dict[str, list] = {}
    seen: dict[str, tuple | None] = dict.fromkeys(ends)  # months that may have more calls, with the last one looked at
    while seen:
        reached = spark.createDataFrame([(m, *(k or (None, None))) for m, k in seen.items()], "month string, last_t long, last_id long")
        rows = judged(found, possible).filter("made AND cost > 0").join(reached, "month").filter("last_t IS NULL OR t > last_t OR t = last_t AND id > last_id")
        # The next calls of every month, NEXT at most: so many rows a month reach the driver.
        following = rows.withColumn("nth", F.row_number().over(Window.partitionBy("month").orderBy("t", "id"))).filter(F.col("nth") <= NEXT).select("month", "t", "id", "run", "cost", "projected", "month_spent", "run_spent").collect()
        by_month: dict[str, list] = {}
        for r in following:
            by_month.setdefault(r["month"], []).append(r)
        for month, calls_ in by_month.items():
            spent, runs = 0, {}
            for r in sorted(calls_, key=lambda r: (r["t"], r["id"])):
                if r["run_spent"] + runs.get(r["run"], 0) + r["projected"] <= run_cap and (r["projected"] == 0 or r["month_spent"] + spent + r["projected"] <= month_cap):
                    found.setdefault(month, []).append((r["t"], r["id"], r["run"], r["cost"]))
                    spent, runs[r["run"]] = spent + r["cost"], runs.get(r["run"], 0) + r["cost"]
                seen[month] = (r["t"], r["id"])
        seen = {m: k for m, k in seen.items() if len(by_month.get(m, [])) == NEXT}
    out = ["month", "run", "id", "made", "why", "used"]
    early = replayed.withColumn("made", F.col("fits")).withColumn("why", F.when(~F.col("fits"), "run")).withColumn("used", F.col("month_before") + F.col("charged"))
    if not ends:
        return early.select(out)
    early = early.join(ended({}).select("month", "end"), "month", "left").filter("end IS NULL OR key < end")
    late = judged(found, tail).withColumn("used", F.col("month_spent") + F.when(F.col("made"), F.col("cost")).otherwise(0))
    return early.select(out).unionByName(late.select(out))
