"""Calls to a service from a DataFrame: bounded asynchronous fan-out, conversations with tools, and retries.

``fan_out`` keeps a bounded number of calls in flight in each task and gives
answers back in the order of the rows; a call that fails is a row with an error.
``retry`` asks again for the keys that are still open, in rounds that are
stored one by one: a task that is run again writes its part of the round again,
and a driver that is started again goes on behind the last complete round.

A task that is lost repeats its calls, so a service sees a call at least once;
what is stored of it is one answer.
"""

from __future__ import annotations

import asyncio
from collections import deque
from collections.abc import AsyncIterator, Awaitable, Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.pinned import scratch
from tessera.sources.readers import _exists

#: Calls in flight in a task, and calls of one key.
IN_FLIGHT, ATTEMPTS = 16, 6

Ask = Callable[[dict[str, Any]], Awaitable[str | None]]


async def _in_order(rows: Iterator[dict], ask: Ask, limit: int, window: int, timeout: float | None) -> AsyncIterator[tuple[str | None, str | None]]:
    """(answer, error) of each row in turn. At most ``limit`` calls run, and ``window`` rows are held."""
    gate = asyncio.Semaphore(limit)

    async def one(row: dict) -> tuple[str | None, str | None]:
        async with gate:
            try:
                return await asyncio.wait_for(ask(row), timeout), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

    held: deque[asyncio.Task] = deque()
    try:
        for row in rows:
            held.append(asyncio.create_task(one(row)))
            if len(held) >= window:
                yield await held.popleft()
        while held:
            yield await held.popleft()
    finally:
        for task in held:
            task.cancel()
        await asyncio.gather(*held, return_exceptions=True)


def fan_out(rows: DataFrame, ask: Ask, limit: int = IN_FLIGHT, window: int | None = None, timeout: float | None = None) -> DataFrame:
    """The rows with ``answer`` and ``error``: what the coroutine ``ask`` returned for each row, or how it failed.

    Each task runs one event loop over its Arrow batches. Results come in the
    order of the rows whatever the order of completion. A slow call holds up at
    most ``window`` rows behind it (4 times ``limit`` by default); beyond these
    no row is read.
    """
    window = 4 * limit if window is None else window
    if not 1 <= limit <= window:
        raise ValueError(f"{limit} calls in flight do not fit in a window of {window} rows")
    taken = {c.lower() for c in rows.columns} & {"answer", "error"}
    if taken:
        raise ValueError(f"the rows have columns of the result's names already: {sorted(taken)}")
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loop = asyncio.new_event_loop()
        waiting: deque[pa.RecordBatch] = deque()

        def asked() -> Iterator[dict]:
            for batch in batches:
                if len(batch):
                    waiting.append(batch)
                    for i in range(len(batch)):
                        yield batch.slice(i, 1).to_pylist()[0]

        answers = _in_order(asked(), ask, limit, window, timeout)
        done: list[tuple[str | None, str | None]] = []
        try:
            while True:
                try:
                    done.append(loop.run_until_complete(anext(answers)))
                except StopAsyncIteration:
                    break
                if len(done) == len(waiting[0]):
                    batch = waiting.popleft()
                    said, failed = zip(*done)
                    done = []
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(failed, pa.string())], names=[*batch.schema.names, "answer", "error"])
        finally:
            loop.run_until_complete(answers.aclose())
            loop.close()

    return rows.mapInArrow(run, schema)


def conversation(reply: Callable[[list[dict]], Awaitable[dict]], tools: dict[str, Callable[[dict], str]], rounds: int, first: Callable[[dict], list[dict]]) -> Ask:
    """A coroutine for ``fan_out`` that holds one conversation a row and answers with its JSON: ``status``, ``calls`` and ``messages``.

    ``reply`` gives the next assistant message, with ``tool_calls`` (name,
    arguments) where it wants tools run; without any the conversation has
    succeeded. A failed reply uses up its round. A tool that is unknown or
    fails answers with an error text and the conversation goes on.
    """
    import json

    async def ask(row: dict) -> str:
        messages, calls = first(row), []
        for turn in range(1, rounds + 1):
            try:
                message = await reply(messages)
            except Exception:  # the next round asks again
                continue
            messages = [*messages, message]
            wanted = message.get("tool_calls") or []
            if not wanted:
                return json.dumps({"status": {"success after": turn}, "calls": calls, "messages": messages})
            for call in wanted:
                try:
                    said = tools[call["name"]](call["arguments"])
                    calls.append(call)
                except KeyError:
                    said = f"Error: no tool has the name {call['name']}"
                except Exception as e:
                    said = f"Error: the tool failed: {e}"
                messages = [*messages, {"role": "tool", "content": said}]
        return json.dumps({"status": {"error after": rounds}, "calls": calls, "messages": messages})

    return ask


def retry(rows: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], most: int = ATTEMPTS, healthy: Callable[[], bool] = lambda: True, path: str | None = None) -> DataFrame:
    """The last outcome of every row with ``attempts`` and ``state``, ``done`` or ``dead``.

    ``attempt`` takes the rows that are open and the number of the attempt, from
    1, and returns their ``key`` with any results and ``error``, which is NULL
    where it worked. Round n is stored under ``path``/n and holds only what was
    open after round n - 1. If anything failed and the service is not
    ``healthy``, the run ends with ``ConnectionError``; called again with the
    same ``path`` it goes on where it stopped. Keys must be distinct and not null.
    """
    spark = rows.sparkSession
    path = path or scratch(spark, "attempts")
    out, opened = None, rows
    for n in range(1, most + 1):
        stored = f"{path}/{n}"
        if not _exists(spark, f"{stored}/_SUCCESS"):
            attempt(opened, n).withColumns({"attempts": F.lit(n)}).write.mode("overwrite").parquet(stored)
        outcome = spark.read.parquet(stored)
        failed = outcome.where("error is not null")
        over = n == most or not failed.limit(1).count()
        part = outcome.withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("dead"))
        part = part if over else part.where("error is null")
        out = part if out is None else out.unionByName(part)
        if over:
            return out
        if not healthy():
            raise ConnectionError(f"the service is down after attempt {n}; its outcomes are kept in {path}")
        # Read back, so the set of open keys is never worked out twice.
        opened = rows.join(failed.select(key), key, "left_semi")
    raise ValueError("at least one attempt is needed")
