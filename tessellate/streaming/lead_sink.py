"""Leads as they come: to files first, then to a webhook.

A batch is written under its number, so one that Spark runs again after a failure replaces what it wrote and no lead stands
twice.  The webhook comes after the file.  What it refuses stops nothing: refused leads are kept with their batch and
tried again with the next one.  A lead may reach the webhook twice (a crash between its answer and our note of it), it
never goes missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeadSink:
    """path: a folder with leads/batch=N, and with a webhook posted/batch=N, in JSON lines. post(lead) -> was it taken? It runs on executors; an exception counts as no."""

    def __init__(self, path: str, post: Callable[[dict], bool] | None = None):
        self.path, self.post = path.rstrip("/"), post

    def leads(self, spark) -> DataFrame:
        return spark.read.json(f"{self.path}/leads")

    def posted(self, spark) -> DataFrame:
        """(lead, taken, batch): the lead as JSON; one that was refused stands again in the next batch."""
        return spark.read.schema("lead string, taken boolean, batch long").json(f"{self.path}/posted")

    def write(self, batch: DataFrame, number: int) -> None:
        stamped = batch.withColumn("received_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        stamped.write.mode("overwrite").json(f"{self.path}/leads/batch={number}")
        if self.post is None:
            return
        spark, post = batch.sparkSession, self.post
        fresh = spark.read.schema(stamped.schema).json(f"{self.path}/leads/batch={number}")
        due = fresh.select(F.to_json(F.struct(*fresh.columns)).alias("lead"))
        if number > 0:
            due = due.unionByName(self.posted(spark).filter((F.col("batch") == number - 1) & ~F.col("taken")).select("lead"))

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            for f in frames:
                taken = []
                for lead in f["lead"]:
                    try:
                        taken.append(bool(post(json.loads(lead))))
                    except Exception:  # noqa: BLE001  whatever the other side does, the lead is in the file
                        taken.append(False)
                yield pd.DataFrame({"lead": f["lead"], "taken": taken})

        due.mapInPandas(send, "lead string, taken boolean").write.mode("overwrite").json(f"{self.path}/posted/batch={number}")

    def start(self, leads: DataFrame, checkpoint: str, **trigger):
        return leads.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
