"""Player profiles over all games, by name, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators.stats import TYPES


def teams_of(names: DataFrame, slots: DataFrame, rosters: DataFrame, game: str) -> DataFrame:
    """(game, name, team, team_name): the first of a game's teams, by slot, whose roster holds the name as it is.

    slots: (game, slot, team, team_name); rosters: (team, name).  Names on no roster have no row.
    """
    held = slots.join(rosters.select("team", "name").distinct(), "team").join(names.select(game, "name").distinct(), [game, "name"])
    return held.groupBy(game, "name").agg(F.min_by(F.struct("team", "team_name"), F.struct("slot", "team")).alias("_t")).select(game, "name", "_t.team", "_t.team_name")


def profiles(records: DataFrame, slots: DataFrame, rosters: DataFrame, results: DataFrame, thumbnails: DataFrame, radar: DataFrame, quality: DataFrame, game: str = "game", player: str = "player") -> DataFrame:
    """One row per trimmed name: sums over its games, games, radar, quality and the first thumbnail.

    records: (game, player, name, day) and the columns of stats.consolidated.
    results: (game, won, lost), names of the winning and the losing team.
    thumbnails: (game, player, thumbnail).  radar: (name, action_type, total, wins).
    quality: (name, action_type, n, scored, average).  A game's result is that of the name's team, see
    teams_of: null without a team or a decision.  Games are listed by day, the
    latest first and those without a day last, of equal days by game and
    player.  Blank and missing names have no profile.
    """
    own = records.withColumn("name", scalars.named(F.col("name"))).where(F.col("name").isNotNull())
    rows = own.join(teams_of(own, slots, rosters, game), [game, "name"], "left").join(results.select(game, "won", "lost"), game, "left").join(thumbnails.select(game, player, "thumbnail"), [game, player], "left")
    result = F.when(F.col("team_name") == F.col("won"), "win").when(F.col("team_name") == F.col("lost"), "loss")
    kinds = [f"n_{t}" for t in TYPES]
    entry = F.struct(F.coalesce("day", F.lit("")).alias("day"), game, player, "total_hits", "rallies", "ending_touches", *kinds, "team", "team_name", result.alias("result"))
    order = lambda a, b: F.when(a["day"] > b["day"], -1).when(a["day"] < b["day"], 1).when(a[game] < b[game], -1).when(a[game] > b[game], 1).when(a[player] < b[player], -1).otherwise(1)
    sums = [F.sum(c).alias(c) for c in ("total_hits", "rallies", "ending_touches", *kinds)]
    first = F.min_by("thumbnail", F.when(F.col("thumbnail").isNotNull(), F.struct(game, player))).alias("thumbnail")
    whole = rows.groupBy("name").agg(*sums, F.count_if(result == "win").alias("wins"), F.count_if(result == "loss").alias("losses"), first, F.array_sort(F.collect_list(entry), order).alias("games"))
    listed = lambda df, name, *columns: df.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("action_type", *columns))).alias(name))
    rate = radar.withColumn("rate", F.expr("try_divide(wins, total)"))
    return whole.join(listed(rate, "radar", "total", "wins", "rate"), "name", "left").join(listed(quality, "quality", "n", "scored", "average"), "name", "left")
