"""Stateful operators, as Structured Streaming runs them and as a batch replay gives them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import place
from .budget import within_budgets
from .job_queue import OUT as QUEUE_ROW
from .job_queue import queue_stream, state_store

WINDOW_S, MOST, LIMIT = 3600, 10, 2
RUN_CAP, MONTH_CAP, POOLS = 60, 2000, 4


def admit(times: list[int], taken: list[int], most: int = MOST, window: int = WINDOW_S) -> tuple[list[tuple[bool, int]], list[int]]:
    """Each request in order: let in, or refused with the seconds to wait. Refused ones do not count."""
    out = []
    for t in times:
        taken = [x for x in taken if t - x < window]
        if len(taken) >= most:
            out.append((False, window - (t - taken[0])))
        else:
            taken.append(t)
            out.append((True, 0))
    return out, taken


def rate_limited(requests: DataFrame, most: int = MOST) -> DataFrame:
    """requests(client, id, t) -> (client, id, allowed, retry_after_s), exact. A client's requests are replayed in order.

    Rows are streamed through sorted partitions, and only the last ``most`` times of one client are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, taken = None, []
        for f in frames:
            allowed, wait = [], []
            for c, t in zip(f["client"].tolist(), f["t"].tolist()):
                if c != client:
                    client, taken = c, []
                (one,), taken = admit([t], taken, most)
                allowed.append(one[0]), wait.append(one[1])
            yield pd.DataFrame({"client": f["client"], "id": f["id"], "allowed": allowed, "retry_after_s": wait})

    ordered = requests.select("client", "id", "t").repartition("client").sortWithinPartitions("client", "t", "id")
    return ordered.mapInPandas(run, "client long, id long, allowed boolean, retry_after_s long")


def within_budget(calls: DataFrame, cap: int) -> DataFrame:
    """calls(month, id, t, cost) -> those that a monthly cap let through: a call that would go over it is skipped and costs nothing."""
    each = calls.select("month", F.col("id").cast("string").alias("run"), "id", "t", F.col("cost").alias("projected"), "cost")
    return within_budgets(each, month_cap=cap).select("month", "id", "made", "used")


def limiter_stream(requests: DataFrame, most: int = MOST) -> DataFrame:
    """The limiter over a stream requests(client, id, t): state is a client's last times, dropped when they are old."""

    def step(key, frames, state):
        taken = list(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values(["t", "id"])
            verdicts, taken = admit(f["t"].tolist(), taken, most)
            yield pd.DataFrame({"client": key[0], "id": f["id"].to_numpy(), "allowed": [v[0] for v in verdicts], "retry_after_s": [v[1] for v in verdicts]})
        state.update((taken,))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return requests.groupBy("client").applyInPandasWithState(step, "client long, id long, allowed boolean, retry_after_s long", "taken array<long>", "append", GroupStateTimeout.NoTimeout)


def job_stream(changes: DataFrame, watchdog: str = "150 seconds") -> DataFrame:
    """changes(host, state, ts) -> each host's state as it changes; a host that says nothing for the watchdog's time has failed."""

    def step(key, frames, state):
        if state.hasTimedOut:
            held = state.get[0]
            state.remove()
            if held == "running":
                yield pd.DataFrame({"host": [key[0]], "state": ["error"]})
            return
        last = None
        for f in frames:
            last = f.sort_values("ts")["state"].iloc[-1]
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 1 + int(watchdog.split()[0]) * 1000)
        yield pd.DataFrame({"host": [key[0]], "state": [last]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy("host").applyInPandasWithState(step, "host string, state string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_activity(posts: DataFrame) -> DataFrame:
    """A stream posts(company, ts, is_post) in hours, an hour late at most: our own form of the trailing counts."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy("company", F.window("ts", "1 hour")).agg(F.count("*").alias("events"), F.count_if("is_post").alias("posts"))


def append_leads(leads: DataFrame, path: str, checkpoint: str):
    """Leads to JSON lines as they come. The file is written first; a batch that fails is written again, not twice."""
    return leads.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import registry

    return rate_limited(registry.run("request", spark, sf_dir), most=LIMIT)


def credit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import registry

    return within_budgets(registry.run("budget_call", spark, sf_dir), RUN_CAP, MONTH_CAP)


def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of runs that are asked for and end gives, two at a time in each of POOLS pools: (pool, host, state, at)."""
    from ..plans import registry

    at = place(spark, "job-queue")
    events = registry.run("job_event", spark, sf_dir).select(F.concat(F.lit("pool "), F.pmod(F.xxhash64("host"), F.lit(POOLS))).alias("pool"), "id", "host", "kind", "ts")
    events.write.parquet(f"{at}/in")
    before = state_store(spark)
    out = queue_stream(spark.readStream.schema(events.schema).parquet(f"{at}/in")).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    state_store(spark, before)
    return spark.read.schema(QUEUE_ROW).parquet(f"{at}/out")


def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job states that the stream of events gives, run to its end: (host, state), a row a change."""
    from ..plans import registry

    at = place(spark, "job-states")
    events = registry.run("job_event", spark, sf_dir).select("host", "state", "ts")
    events.write.parquet(f"{at}/in")
    changes = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    out = job_stream(changes).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("host string, state string").parquet(f"{at}/out")


QUERIES = {"rate_limit": rate_limit, "credit_budget": credit_budget, "job_queue": job_queue, "job_state_stream": job_state_stream}


def _checks() -> dict[str, str]:
    """The replays as recursive SQL: a call, or a request of every client, a step."""
    from ..plans import registry

    calls, requests = registry.text("budget_call", registry.DUCK)[0], registry.text("request", registry.DUCK)[0]
    room = f"CASE WHEN held + c.projected > {RUN_CAP} THEN 'run' WHEN c.projected > 0 AND w.spent + c.projected > {MONTH_CAP} THEN 'month' END"
    budget = f"""
WITH RECURSIVE calls AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY month ORDER BY t, id) AS n FROM ({calls})),
walk AS (
  SELECT DISTINCT month, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, MAP {{'': CAST(0 AS BIGINT)}} AS runs, CAST(NULL AS BIGINT) AS id, '' AS run, CAST(NULL AS VARCHAR) AS why FROM calls
  UNION ALL
  SELECT month, n, spent + CASE WHEN why IS NULL THEN cost ELSE 0 END, CASE WHEN why IS NULL THEN map_concat(runs, MAP {{run: held + cost}}) ELSE runs END, id, run, why FROM (
    SELECT w.month, c.n, w.spent, w.runs, c.id, c.run, CAST(c.cost AS BIGINT) AS cost, coalesce(w.runs[c.run], 0) AS held, {room} AS why FROM walk w JOIN calls c ON c.month = w.month AND c.n = w.n + 1))
SELECT month, run, id, why IS NULL AS made, why, spent AS used FROM walk WHERE id IS NOT NULL"""
    limit = f"""
WITH RECURSIVE asked AS MATERIALIZED (SELECT client, id, t, row_number() OVER (PARTITION BY client ORDER BY t, id) AS n FROM ({requests})),
walk AS (
  SELECT DISTINCT client, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS id, false AS allowed, CAST(0 AS BIGINT) AS wait FROM asked
  UNION ALL
  SELECT client, n, CASE WHEN len(held) < {LIMIT} THEN list_append(held, t) ELSE held END, id, len(held) < {LIMIT}, CASE WHEN len(held) < {LIMIT} THEN 0 ELSE {WINDOW_S} - (t - held[1]) END FROM (
    SELECT a.client, a.n, a.t, a.id, list_filter(w.taken, lambda x: a.t - x < {WINDOW_S}) AS held FROM walk w JOIN asked a ON a.client = w.client AND a.n = w.n + 1))
SELECT client, id, allowed, wait AS retry_after_s FROM walk WHERE id IS NOT NULL"""
    return {"credit_budget": budget, "rate_limit": limit}


CHECKS = _checks()
