"""Event-shaped state: request budgets, toggles, retained matches, queues."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .ranking import last_marked, with_previous


def admit(times: deque, now: int, window_us: int, limit: int) -> tuple[bool, int]:
    """Admit one request and return (admitted, seconds to wait); only admitted requests count."""
    while times and times[0] < now - window_us:
        times.popleft()
    if len(times) >= limit:
        return False, max(1, int((window_us - (now - times[0])) / 1_000_000))
    times.append(now)
    return True, 0


def admission(events: DataFrame, key: str, time_us: str, order: str, window: int = dims.ADMISSION_WINDOW_SECONDS,
              limit: int = dims.ADMISSION_LIMIT) -> DataFrame:
    """Sliding request budget per client: (order, key, admitted, retry_after).

    A pause longer than the window empties the budget, so a client's timeline splits there
    into stretches that know nothing of each other.  A task streams through its sorted
    stretches and holds the admitted times of one window only.
    """
    window_us = window * 1_000_000
    rows = with_previous(events.select(key, time_us, order), [key], [F.col(time_us), F.col(order)], [time_us])
    pause = F.col(f"prev_{time_us}").isNull() | (F.col(time_us) - F.col(f"prev_{time_us}") > window_us)
    cut = last_marked(rows, "n", pause, "stretch").select("stretch", "n", key, time_us, order)
    placed = cut.repartition("stretch").sortWithinPartitions("stretch", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, times = None, deque()
        for frame in batches:
            out = []
            for s, k, now, o in zip(frame["stretch"], frame[key], frame[time_us], frame[order]):
                if s != stretch:
                    stretch, times = s, deque()
                ok, wait = admit(times, int(now), window_us, limit)
                out.append((o, k, ok, wait))
            yield pd.DataFrame(out, columns=[order, key, "admitted", "retry_after"])

    return placed.mapInPandas(run, f"{order} long, {key} long, admitted boolean, retry_after long")


def latest_response(responses: DataFrame, keys: list[str], request: Column, values: list[str]) -> DataFrame:
    """Only the response to the latest request counts."""
    return responses.groupBy(*keys).agg(F.max_by(F.struct(*values), request).alias("v")).select(*keys, "v.*")


def toggles(events: DataFrame, keys: list[str]) -> DataFrame:
    """Saved after an odd number of toggles."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("saved"))


def votes(events: DataFrame, keys: list[str], vote: str, order: list[str]) -> DataFrame:
    """Standing vote per key: the same vote again takes it back, the other one replaces it.

    The state depends on the last vote and on how often it was cast since the last other
    vote, so two aggregates replace a walk through the events.
    """
    at = F.struct(*order)
    last = events.groupBy(*keys).agg(F.max_by(vote, at).alias("last"))
    marked = events.join(last, keys)
    border = marked.where(F.col(vote) != F.col("last")).groupBy(*keys).agg(F.max(at).alias("border"))
    tail = marked.where(F.col(vote) == F.col("last")).join(border, keys, "left").where(F.col("border").isNull() | (at > F.col("border")))
    return tail.groupBy(*keys, "last").agg(F.count("*").alias("times")).where("times % 2 = 1").select(*keys, F.col("last").alias(vote))


def retain_last_good(attempts: DataFrame, key: str, usable: Column, order: list[str], values: list[str], items: str, alive: DataFrame) -> DataFrame:
    """The latest attempt if usable, else the last usable one while every one of its items still exists.

    ``items`` is an array column of ``attempts``, ``alive`` the existing items in a column ``item``.  An attempt without items keeps
    its place, as none of them can be gone; a null item never exists.
    """
    at = F.struct(*order)
    value = F.struct(*values, items, usable.alias("usable"))
    ends = attempts.groupBy(key).agg(F.max_by(value, at).alias("fresh"), F.max_by(value, F.when(usable, at)).alias("good"))
    fields = [*values, items]
    fresh = ends.where("fresh.usable").select(key, *[f"fresh.{f}" for f in fields], F.lit(False).alias("retained"))
    held = ends.where("NOT fresh.usable AND good IS NOT NULL").select(key, *[f"good.{f}" for f in fields], F.lit(True).alias("retained"))
    gone = held.select(key, F.explode(items).alias("item")).join(alive.select("item").distinct(), "item", "left_anti").select(key)
    return fresh.unionByName(held.join(gone.distinct(), key, "left_anti"))


def enqueue_once(events: DataFrame, key: str, enqueue: str, order: list[str]) -> DataFrame:
    """Enqueue events accepted because the key was not pending.

    ``events``: key, a boolean column ``enqueue`` (false = finished) and the order columns.
    """
    rows = with_previous(events, [key], [F.col(o) for o in order], [enqueue])
    return rows.where(F.col(enqueue) & ~F.coalesce(f"prev_{enqueue}", F.lit(False))).select(*events.columns)
