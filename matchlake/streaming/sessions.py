"""Streaming forms: rallies as session windows, dense cells as hopping windows, and the running score as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rally_windows(touches: DataFrame, keys: list[str], time: str, gap: str = "3 hours", late: str = "1 day", least: int = 1) -> DataFrame:
    """(keys, start, end, n) of each session of touches: it ends `gap` after its last touch. Append mode; state is dropped behind the watermark."""
    s = touches.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.where(F.col("n") >= least).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dense_windows(touches: DataFrame, keys: list[str], time: str, span: str, step: str, count: int, late: str = "1 day") -> DataFrame:
    """(keys, start, n) of hopping windows with at least `count` touches."""
    w = touches.withWatermark(time, late).groupBy(*keys, F.window(time, span, step).alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= count).select(*keys, F.col("w.start").alias("start"), "n")


def momentum(winners: DataFrame, game: str, order: str, winner: str, plus: str, minus: str) -> DataFrame:
    """(game, order, momentum) of rallies as they are decided: +1 and -1 summed per game.

    A game's rallies must arrive in order between batches; inside a batch they are sorted. State is one number a game.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        steps = rows[winner].map({plus: 1, minus: -1}).fillna(0).astype(int).cumsum() + total
        state.update((int(steps.iloc[-1]) if len(steps) else total,))
        yield pd.DataFrame({game: rows[game], order: rows[order], "momentum": steps})

    t = winners.schema
    schema = f"{game} {t[game].dataType.simpleString()}, {order} {t[order].dataType.simpleString()}, momentum long"
    return winners.select(game, order, winner).groupBy(game).applyInPandasWithState(run, schema, "total long", "append", GroupStateTimeout.NoTimeout)
