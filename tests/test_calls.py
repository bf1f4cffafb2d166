"""Fan-out and retries: bounds, order, failures, and going on after a stop."""

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import calls as C


def rows(spark, n, parts=2):
    return spark.range(0, n, 1, parts)


@pytest.mark.parametrize("limit, window", [(16, 64), (3, 3), (1, 5)])
def test_no_more_calls_than_allowed(spark, limit, window):
    seen = {"now": 0}

    async def ask(row):
        seen["now"] += 1
        at = seen["now"]
        await asyncio.sleep(0.002 * (row["id"] * 7 % 5))
        seen["now"] -= 1
        return f"{at}"

    got = C.fan_out(rows(spark, 200), ask, limit, window).collect()
    most = max(int(r["answer"]) for r in got)
    assert most == limit and all(r["error"] is None for r in got)


def test_order_of_completion_changes_nothing(spark):
    def asker(turned):
        async def ask(row):
            await asyncio.sleep(0.004 * (row["id"] % 6 if turned else 5 - row["id"] % 6))
            return str(row["id"] * 3)

        return ask

    one, two = ([tuple(r) for r in C.fan_out(rows(spark, 150, 3), asker(t), 8).withColumn("at", F.monotonically_increasing_id()).collect()] for t in (True, False))
    assert one == two and [r[1] for r in one] == [str(3 * i) for i in range(150)]


def test_no_row_beyond_the_window_is_read(spark):
    ahead = {"asked": 0, "done": 0}

    async def ask(row):
        ahead["asked"] += 1
        if row["id"] == 0:
            await asyncio.sleep(0.2)
        ahead["done"] += 1
        return str(ahead["asked"])

    got = C.fan_out(rows(spark, 100, 1), ask, 4, 12).collect()
    assert int(got[0]["answer"]) == 12  # what had been asked when the slow first call ended


def test_errors_timeouts_and_nulls_are_rows(spark):
    async def ask(row):
        if row["id"] == 1:
            raise KeyError("no")
        if row["id"] == 2:
            await asyncio.sleep(5)
        return None if row["id"] == 3 else "ok"

    got = [(r["answer"], (r["error"] or "").split(":")[0]) for r in C.fan_out(rows(spark, 5, 1), ask, timeout=0.1).collect()]
    assert got == [("ok", ""), (None, "KeyError"), (None, "TimeoutError"), (None, ""), ("ok", "")]
    assert C.fan_out(rows(spark, 0), ask).collect() == []
    with pytest.raises(ValueError, match="answer"):
        C.fan_out(rows(spark, 1).withColumn("Answer", F.lit(1)), ask)
    with pytest.raises(ValueError, match="window"):
        C.fan_out(rows(spark, 1), ask, 4, 2)
    assert len(C.fan_out(rows(spark, 5000, 1), lambda row: asyncio.sleep(0, "x")).limit(3).collect()) == 3


def test_a_failed_reply_uses_up_its_round():
    tries = []

    async def reply(messages):
        tries.append(len(messages))
        if len(tries) == 1:
            raise ConnectionError
        return {"role": "assistant", "content": "", "tool_calls": [{"name": "bad", "arguments": {}}]} if len(tries) == 2 else {"role": "assistant", "content": "end"}

    ask = C.conversation(reply, {"bad": lambda a: 1 / 0}, 5, lambda row: [{"role": "user", "content": "q"}])
    said = json.loads(asyncio.run(ask({})))
    assert said["status"] == {"success after": 3} and said["calls"] == [] and tries == [1, 1, 3]
    assert said["messages"][2]["content"].startswith("Error: the tool failed")
    assert json.loads(asyncio.run(C.conversation(reply, {}, 0, lambda row: [])({})))["status"] == {"error after": 0}


def test_retry_goes_on_behind_the_last_round(spark, tmp_path):
    asked = []

    def attempt(opened, n):
        asked.append((n, opened.count()))
        return opened.withColumn("error", F.when(F.col("id") % 4 >= n, "busy"))

    up = iter([True, False])
    with pytest.raises(ConnectionError, match="attempt 2"):
        C.retry(rows(spark, 40), "id", attempt, 3, lambda: next(up), f"file://{tmp_path}/a")
    got = C.retry(rows(spark, 40), "id", attempt, 3, path=f"file://{tmp_path}/a").collect()
    assert asked == [(1, 40), (2, 30), (3, 20)]
    assert {(r["id"] % 4, r["attempts"], r["state"]) for r in got} == {(0, 1, "done"), (1, 2, "done"), (2, 3, "done"), (3, 3, "dead")}
    assert len(got) == 40
    none = C.retry(rows(spark, 0), "id", attempt, 3, path=f"file://{tmp_path}/b")
    assert none.collect() == []
