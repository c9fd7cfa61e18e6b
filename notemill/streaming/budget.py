"""Token budgets over time: trailing sums in batch and stream, and a rate limiter for tasks."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_sum(events: DataFrame, time_column: str, value: str, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """``events`` with ``trailing``: sum of ``value`` over less than ``seconds`` before each event, itself included.

    Time is cut into spans of ``seconds``; each span is a partition that also sees the rows of the
    one before it, so the window is exact and no task holds more than two spans.  Rows of one span
    are the bound; null times are dropped, null values count nothing.
    """
    micros = F.unix_micros(F.col(time_column).cast("timestamp"))
    width = seconds * 1_000_000
    own = events.where(F.col(time_column).isNotNull()).withColumn("_us", micros).withColumn("_span", F.expr(f"_us div {width}"))
    seen = own.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", F.col("_span") + F.col("_copy"))
    window = Window.partitionBy(*(keys or []), "_span").orderBy("_us").rangeBetween(-(width - 1), 0)
    return seen.withColumn("trailing", F.sum(value).over(window)).where("_copy = 0").drop("_us", "_span", "_copy")


def windowed_tokens(stream: DataFrame, time_column: str, value: str, width: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Streaming form: tokens by sliding window, late rows accepted within the watermark."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width, slide)).agg(F.sum(value).alias("tokens"), F.count("*").alias("requests"))


class TokenBudget:
    """Keeps calls within tokens and requests a minute; a task gets its share of the whole."""

    def __init__(self, tokens: int = 200_000, requests: int = 1_000, tasks: int = 5, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.tokens, self.requests = tokens / tasks, requests / tasks
        self.clock, self.sleep = clock, sleep
        self.spent: deque[tuple[float, float]] = deque()

    def used(self) -> float:
        """Tokens of the last 60 seconds."""
        now = self.clock()
        while self.spent and now - self.spent[0][0] >= 60:
            self.spent.popleft()
        return sum(n for _, n in self.spent)

    def take(self, tokens: float) -> None:
        """Wait until the budget has room, then book the tokens; a call above the whole budget waits for an empty one."""
        while self.spent and (self.used() + tokens > self.tokens or len(self.spent) >= self.requests):
            if self.spent:
                self.sleep(max(0.01, 60 - (self.clock() - self.spent[0][0])))
        self.spent.append((self.clock(), tokens))
