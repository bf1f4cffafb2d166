"""Calls to a service. The service here is a coroutine whose answers and failures are hashes of its question."""

from __future__ import annotations

import asyncio
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import calls as C
from tessera.plans.registry import Registry, table

registry = Registry()
query = registry.query


def _draw(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:4], 16)


async def _echo(row: dict) -> str:
    """Answers late by a draw, so that calls end in another order than they began."""
    await asyncio.sleep(_draw("late", row["conv_id"], row["turn"]) / 65536 / 500)
    if not row["text"] or len(row["text"]) % 7 == 0:
        raise ValueError(f"turn {row['turn']} is refused")
    return hashlib.md5(row["text"].encode()).hexdigest()[:12]


@query("""
SELECT conv_id, turn, CASE WHEN text <> '' AND length(text) % 7 <> 0 THEN substr(md5(text), 1, 12) END AS answer,
  CASE WHEN coalesce(text, '') = '' OR length(text) % 7 = 0 THEN 'ValueError: turn ' || turn || ' is refused' END AS error FROM conversations""")
def fan_out_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation is a call, 16 of them at a time in each task."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return C.fan_out(turns, _echo).drop("text")


async def _assistant(messages: list[dict]) -> dict:
    """Wants a tool as often as the first message's length says, refuses in between where the draw says so."""
    n, tool_turns = len(messages[0]["content"]), sum(m["role"] == "tool" for m in messages)
    await asyncio.sleep(0)
    if tool_turns < n % 5:
        return {"role": "assistant", "content": "", "tool_calls": [{"name": "length" if n % 3 else "weight", "arguments": {"of": messages[0]["content"]}}]}
    return {"role": "assistant", "content": f"{n} after {tool_turns}"}


@query("""
WITH q AS (SELECT conv_id, length(text) AS n, length(text) % 5 AS uses FROM conversations WHERE turn = 0)
SELECT conv_id, CASE WHEN uses < 4 THEN 'success after' ELSE 'error after' END AS status, least(uses + 1, 4)::INT AS rounds,
  CASE WHEN n % 3 = 0 THEN 0 ELSE least(uses, 4) END::INT AS calls, CASE WHEN uses < 4 THEN n || ' after ' || uses END AS said FROM q""")
def fan_out_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation of at most four rounds about each first turn, with a tool that is there and one that is not."""
    first = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "text")
    ask = C.conversation(_assistant, {"length": lambda a: str(len(a["of"]))}, 4, lambda row: [{"role": "user", "content": row["text"]}])
    got = F.from_json("answer", "status map<string,int>, calls array<string>, messages array<struct<role string, content string>>")
    rows = C.fan_out(first, ask).select("conv_id", got.alias("r")).select("conv_id", F.map_keys("r.status")[0].alias("status"), F.map_values("r.status")[0].alias("rounds"), F.size("r.calls").alias("calls"), F.element_at("r.messages", -1).alias("last"))
    return rows.select("conv_id", "status", "rounds", "calls", F.when(F.col("last.role") == "assistant", F.when(F.col("status") == "success after", F.col("last.content"))).alias("said"))


def _fails(key: object, attempt: int) -> bool:
    return _draw("busy", key, attempt) < 40_000


@query("""
WITH a AS (SELECT c_custkey, n, ('0x' || substr(md5('busy:' || c_custkey || ':' || n), 1, 4))::INT < 40000 AS failed FROM customer, (SELECT unnest(range(1, 7)) AS n)),
f AS (SELECT c_custkey, min(n) FILTER (WHERE NOT failed) AS n FROM a GROUP BY c_custkey)
SELECT c_custkey, coalesce(n, 6)::INT AS attempts, CASE WHEN n IS NULL THEN 'dead' ELSE 'done' END AS state, CASE WHEN n IS NULL THEN 'ConnectionError: busy' END AS error,
  CASE WHEN n IS NOT NULL THEN 'answer ' || n END AS answer FROM f""")
def retry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each customer that fails by a hash of key and attempt: six attempts, then it is a dead letter."""

    def attempt(opened: DataFrame, n: int) -> DataFrame:
        async def ask(row: dict) -> str:
            await asyncio.sleep(0)
            if _fails(row["c_custkey"], n):
                raise ConnectionError("busy")
            return f"answer {n}"

        return C.fan_out(opened, ask)

    return C.retry(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", attempt).select("c_custkey", "attempts", "state", "error", "answer")
