"""Replays of a rate limiter's state over a log of requests (key, at: seconds, tokens)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_windows(log: DataFrame, seconds: float = 60.0) -> DataFrame:
    """key, at, tokens, window, in_window: a window starts with the first request after the last one is over, so windows are not aligned."""

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "tokens"], kind="stable").reset_index(drop=True)
        start, number, count, out = -math.inf, -1, 0, []
        for at in part["at"]:
            if at - start >= seconds:
                start, number, count = at, number + 1, 0
            count += 1
            out.append((number, count))
        part[["window", "in_window"]] = pd.DataFrame(out, columns=["window", "in_window"], dtype="int64")
        return part

    return log.select("key", "at", "tokens").groupBy("key").applyInPandas(replay, "key string, at double, tokens long, window long, in_window long")


def token_bucket(log: DataFrame, per_minute: float) -> DataFrame:
    """key, at, tokens, wait, left: how long each request waits for its tokens, and what is left then; the bucket fills steadily up to a minute's worth."""
    rate = per_minute / 60.0

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "tokens"], kind="stable").reset_index(drop=True)
        level, now, waits, lefts = per_minute, -math.inf, [], []
        for at, tokens in zip(part["at"], part["tokens"], strict=True):
            level = per_minute if now == -math.inf else min(per_minute, level + max(0.0, at - now) * rate)
            now = max(now, at)
            need = min(float(tokens), per_minute)
            wait = max(0.0, (need - level) / rate)
            level, now = level + wait * rate - need, now + wait
            waits.append(now - at)
            lefts.append(level)
        part["wait"], part["left"] = waits, lefts
        return part

    return log.select("key", "at", "tokens").groupBy("key").applyInPandas(replay, "key string, at double, tokens long, wait double, left double")


def reservations(history: DataFrame, last: int = 20, least: int = 128) -> DataFrame:
    """key, ord, reserve: output tokens to set aside, from the last uses of a key: its 90th percentile and its mean with margins."""
    window = Window.partitionBy("key").orderBy("ord").rowsBetween(-(last - 1), 0)
    ranked = F.array_sort(F.collect_list("tokens").over(window))
    high = F.element_at(ranked, F.ceil(F.size(ranked) * 0.9).cast("int"))
    return history.select("key", "ord", F.ceil(F.greatest(high * 1.2, F.avg("tokens").over(window) * 1.35, F.lit(float(least)))).cast("long").alias("reserve"))
