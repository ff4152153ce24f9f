"""Runs that call a service for rows: batches, retries, budgets, resumption, rounds until all are covered."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.sources.sinks import merged_metadata

Call = Callable[[list[str]], list[str | None]]


def with_retries(call: Call, texts: list[str], each: bool = True, most: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str | None], int]:
    """Answers in order and the number of calls. A failed call is tried again after twice the wait, with ``each`` only for texts without answer.

    What has no answer after ``most`` tries is None.
    """
    found: list[str | None] = [None] * len(texts)
    left, calls = list(range(len(texts))), 0
    for i in range(most):
        if not left:
            break
        if i:
            sleep(wait * 2 ** (i - 1))
        calls += 1
        try:
            got = call([texts[k] for k in left])
        except Exception:  # noqa: BLE001  the service failed as a whole
            continue
        if not each and any(g is None for g in got):
            continue
        for k, g in zip(left, got, strict=True):
            found[k] = g
        left = [k for k in left if found[k] is None]
    return found, calls


def answered(df: DataFrame, text: str, call: Call, batch: int = 90, each: bool = True, most: int = 3, wait: float = 1.0, pause: float = 0.0) -> DataFrame:
    """Adds ``answer`` and ``reason`` (null where answered). Rows go in batches of ``batch``; as many run at once as there are tasks."""

    @F.pandas_udf("answer string, reason string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str | None] = []
            texts = b.fillna("").tolist()
            for i in range(0, len(texts), batch):
                if i and pause:
                    time.sleep(pause)
                out += with_retries(call, texts[i : i + batch], each, most, wait)[0]
            yield pd.DataFrame({"answer": out, "reason": [None if a is not None else "no_answer" for a in out]})

    return df.withColumn("__a", run(F.col(text))).select("*", "__a.answer", "__a.reason").drop("__a")


class Budget:
    """Calls that a whole run may make."""

    def __init__(self, most: int, spent: int = 0):
        self.most, self.spent = most, spent

    @property
    def left(self) -> int:
        return max(0, self.most - self.spent)

    @property
    def exhausted(self) -> bool:
        return self.left == 0

    def record(self, n: int) -> None:
        self.spent += n

    def grant(self, n: int) -> int:
        """How many of ``n`` calls may be made; they count as made."""
        given = min(n, self.left)
        self.spent += given
        return given


def covered(rows: DataFrame, key: str, done: Callable[[], DataFrame], step: Callable[[DataFrame, int], None], rounds: int = 4) -> DataFrame:
    """Calls ``step`` for the rows that ``done()`` lacks, until it lacks none or ``rounds`` are over; gives the rows still missing.

    ``step`` gets the missing rows and the round (from 0) and writes what ``done``
    reads, so an interrupted run goes on where it stopped.
    """
    missing = rows.join(done().select(key), key, "left_anti")
    for i in range(rounds):
        if not missing.limit(1).count():
            break
        step(missing, i)
        missing = rows.join(done().select(key), key, "left_anti")
    return missing


def bounded_run(spark: SparkSession, files: list[str], process: Callable[[str], int], most_rows: int = 50_000, most_files: int = 10, budget: Budget | None = None, state: dict | None = None) -> dict:
    """Processes files in order, each once, and stops at a number of rows, of files, or at the end of the budget.

    ``state`` is the cumulative metadata so far; a file that it has is passed
    over. ``process`` gives the rows that a file yields. The result is the new
    state with the reason for stopping, null if all files are done.
    """
    state, tried = dict(state or {"files": {}, "total": 0, "stopped_reason": None}), 0
    for path in files:
        stem = path.rsplit("/", 1)[-1].split(".")[0]
        if stem in state["files"]:
            continue
        reason = "rows" if state["total"] >= most_rows else "files" if tried >= most_files else "budget" if budget is not None and budget.exhausted else None
        if reason:
            return {**state, "stopped_reason": reason}
        tried += 1
        state = merged_metadata(state, stem, process(path))
    return {**state, "stopped_reason": None}
