"""Budgets, job queue and lead sink against replays in plain Python, and over restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessellate.operators.ordered import running
from tessellate.streaming import budget, job_queue, lead_sink


def replay(calls, run_cap, month_cap):
    runs, months, out = {}, {}, {}
    for month, run, i, t, projected, cost in sorted(calls, key=lambda c: (c[3], c[2])):
        spent, whole = runs.get((month, run), 0), months.get(month, 0)
        why = "run" if spent + projected > run_cap else "month" if projected and whole + projected > month_cap else None
        if not why:
            runs[month, run], months[month] = spent + cost, whole + cost
        out[month, i] = (why is None, why, months.get(month, 0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_three_bounds_are_the_replay(spark, seed):
    rnd = random.Random(seed)
    calls = [(f"2024-0{1 + k % 2}", f"r{rnd.randrange(12)}", k, rnd.randrange(300), p, rnd.choice([0, 1, p, p])) for k in range(260) for p in [rnd.choice([0, 1, 5, 25])]]
    frame = spark.createDataFrame(calls, "month string, run string, id long, t long, projected long, cost long")
    for run_cap, month_cap in ((40, 200), (60, 90), (10, 10_000), (1000, 1), (budget.UNBOUNDED, 150)):
        got = {(r.month, r.id): (r.made, r.why, r.used) for r in budget.within_budgets(frame, run_cap, month_cap).collect()}
        assert got == replay(calls, run_cap, month_cap)
    assert budget.within_budgets(frame.limit(0), 1, 1).count() == 0


def test_running_sums_split_a_group(spark):
    rows = [("a", k, k % 7) for k in range(300)] + [("b", k, 1) for k in range(5)] + [(None, 1, 9), (None, 2, 9)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    out = running(df, "g", ["k"], "v", "before", partitions=9)
    want = {(g, k): sum(v2 for g2, k2, v2 in rows if g2 == g and k2 < k) for g, k, _ in rows}
    assert {(r.g, r.k): r.before for r in out.collect()} == want


def test_two_run_and_the_third_waits():
    pool = job_queue.Pool()
    for k, host in enumerate(["a", "b", "c", "c", "a"]):
        pool.event(host, "request", k)
    assert pool.state == {"a": "running", "b": "running", "c": "queued"}
    pool.event("b", "ready", 10)
    assert pool.state["c"] == "running" and pool.changes[-2:] == [("b", "ready", 10), ("c", "running", 10)]
    pool.event("d", "request", 20)
    pool.until(150_000)
    assert pool.state["a"] == "error" and pool.state["d"] == "running" and ("d", "running", 150_000) in pool.changes
    pool.event("a", "ready", 150_001)
    assert pool.state["a"] == "ready" and set(pool.running) == {"c", "d"}
    pool.event("c", "error", 150_005)
    pool.event("c", "request", 150_006)
    assert pool.state["c"] == "running"


def test_queue_as_a_stream(spark, tmp_path):
    job_queue.state_store(spark)
    rnd = random.Random(5)
    events, t = [], 0
    for k in range(120):
        t += rnd.choice([1, 500, 30_000])
        events.append((f"p{k % 2}", k, f"h{rnd.randrange(6)}", rnd.choice(["request", "request", "ready", "error"]), t))
    want = []
    for p in ("p0", "p1"):
        pool = job_queue.Pool()
        for q, _, host, kind, at in events:
            if q == p:
                pool.event(host, kind, at)
        pool.until(10**9)
        want += [(p, *c) for c in pool.changes]
    source = tmp_path / "in"
    schema = "pool string, id long, host string, kind string, ms long"
    batches = [events[:50], events[50:90], events[90:], [("p9", 999, "last", "request", 10**9)], [("p9", 1000, "last", "ready", 10**9 + 1)]]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"b={k}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("ts", F.timestamp_millis("ms"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = job_queue.queue_stream(stream.select("pool", "id", "host", "kind", "ts")).writeStream.format("memory").queryName("queue").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [(r.pool, r.host, r.state, r.ms) for r in spark.table("queue").selectExpr("*", "unix_millis(at) AS ms").collect() if r.pool != "p9"]
    assert sorted(got) == sorted(want)
    assert any(s == "error" for _, _, s, _ in got) and any(s == "queued" for _, _, s, _ in got)


def test_leads_stand_once_and_refused_ones_are_tried_again(spark, tmp_path):
    source, seen = tmp_path / "in", tmp_path / "seen.txt"
    schema = "id long, mail string"

    def post(lead):
        text = seen.read_text() if seen.exists() else ""
        seen.write_text(text + json.dumps(lead) + "\n")
        return not (lead["id"] == 1 and text.count('"id": 1,') == 0)  # the first time, the other side refuses one

    sink = lead_sink.LeadSink(str(tmp_path / "out"), post)
    run = lambda s: s.start(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "cp")).awaitTermination(90)
    spark.createDataFrame([(0, "a"), (1, "b")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run(sink)
    assert {(json.loads(r.lead)["id"], r.taken) for r in sink.posted(spark).collect()} == {(0, True), (1, False)}
    spark.createDataFrame([(2, "c")], schema).coalesce(1).write.mode("append").parquet(str(source))

    class Dies(lead_sink.LeadSink):
        def write(self, batch, number):
            super().write(batch, number)
            raise RuntimeError("after the file and the webhook")

    with pytest.raises(Exception, match="after the file"):
        run(Dies(str(tmp_path / "out"), post))
    run(sink)  # the batch runs again
    assert sorted(r.id for r in sink.leads(spark).collect()) == [0, 1, 2]
    assert {(json.loads(r.lead)["id"], r.taken) for r in sink.posted(spark).filter("batch = 1").collect()} == {(1, True), (2, True)}
    plain = lead_sink.LeadSink(str(tmp_path / "plain"))
    plain.write(spark.createDataFrame([(7, "x")], schema), 0)
    assert [r.id for r in plain.leads(spark).collect()] == [7]
