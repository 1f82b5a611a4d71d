"""Attribution with state: the same as the batch operator, in any order of arrival and over a restart."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import usage
from tidemark.streaming import refresh

SCHEMA = "source string, path string, kind string, id long, at long"


def test_stream_attributes_as_the_batch_does(spark, tmp_path):
    rng = random.Random(3)
    rows, start = [], 1_900_000_000
    for i in range(160):
        at = start + rng.randint(0, 1500)
        rows.append((rng.choice("ab"), f"p{rng.randint(0, 4)}", rng.choice(["search", "search", "read"]), i, at))
    table = spark.createDataFrame(rows, SCHEMA)
    reads = table.where("kind = 'read'").select("source", "path", F.col("id").alias("read_id"), F.col("at").alias("read_at"))
    searches = table.where("kind = 'search'").select("source", "path", F.col("id").alias("search_id"), F.col("at").alias("search_at"))
    want = sorted((r["read_id"], r["search_id"], r["lag"]) for r in usage.attribute(reads, searches, ["source", "path"]).collect())
    assert len(want) >= 15
    rng.shuffle(rows)
    inbox, got = tmp_path / "in", []
    inbox.mkdir()
    for k, part in enumerate((rows[:50], rows[50:110], [*rows[110:], ("end", "x", "read", 999, start + 9000)])):
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(str(inbox))
        events = spark.readStream.schema("source string, path string, kind string, id long, ts timestamp").parquet(str(inbox))
        found = refresh.attributed_once(events, late="1 hour")
        query = found.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()  # each part in a query of its own, from the checkpoint of the one before
        assert not query.exception() and (k == 2 or not got)
    assert sorted((r["read_id"], r["search_id"], r["lag"]) for r in got) == want


def test_state_holds_few_searches():
    held = {}

    class State:
        def __init__(self, name):
            self.name = name

        def exists(self):
            return bool(held.get(self.name))

        def get(self):
            return iter(held.get(self.name, []))

        def put(self, rows):
            held[self.name] = list(rows)

        def clear(self):
            held.pop(self.name, None)

        def appendList(self, rows):
            held.setdefault(self.name, []).extend(rows)

    class Handle:
        def getListState(self, name, _):
            return State(name)

        def registerTimer(self, at):
            held["timer"] = at

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now


    one, clock = refresh.Attribution(60, 64), Clock()
    one.init(Handle())
    for second in range(300):
        clock.now = (second - 5) * 1000
        list(one.handleInputRows(("a",), iter([pd.DataFrame({"path": [f"p{second}_{i}" for i in range(40)], "kind": "search", "id": range(40), "at": second})]), clock))
        assert len(held.get("searches", [])) <= 64 and len(held.get("waiting", [])) <= 40 * 7
    clock.now = 10**9
    list(one.handleExpiredTimer(("a",), clock, None))
    assert "waiting" not in held
