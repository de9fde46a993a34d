"""Contacts, arcs, merge costs, replays and profiles on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import contacts, detection, graph, members, profiles, quality, spatial, stats
from matchlake.params import Params
from matchlake.plans.bindings import TOUCHES, table, touches
from matchlake.plans.detection import _CAND, _cand
from matchlake.plans.scoring import _SERVE, SCORED, _factors, _mean, wide
from matchlake.plans.tracking import _WON, _won

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


_SIDES = ", ".join(
    f"count(*) FILTER ({s}) AS n_{n}, count(cx) FILTER ({s}) AS c_{n}, count(height) FILTER ({s}) AS z_{n}, "
    + ", ".join(f"regr_intercept({v}, t) FILTER ({s}) AS {v}_{n}, regr_slope({v}, t) FILTER ({s}) AS v{v}_{n}" for v in ("px", "py", "cx", "cy"))
    + f", regr_intercept(height + 0.5 * 9.81 * t * t, t) FILTER ({s}) AS h_{n}, regr_slope(height + 0.5 * 9.81 * t * t, t) FILTER ({s}) AS vh_{n}"
    for n, s in (("i", "f <= frame"), ("o", "f >= frame"))
)


@query(f"""WITH {TOUCHES}, pts AS (SELECT game, frame AS f, avg(x) * 50 AS px, avg(y) * 50 AS py, CASE WHEN game % 3 <> 0 THEN avg(x) END AS cx, CASE WHEN game % 3 <> 0 THEN avg(y) END AS cy, max(height) AS height FROM touches WHERE touch_id % 5 <> 0 GROUP BY game, frame),
hits AS (SELECT game, frame, min(rally // 16) AS grp FROM touches WHERE action_type = 'spike' AND touch_id % 4 = 0 GROUP BY ALL), grps AS (SELECT game, rally // 16 AS grp, min(frame) AS s, max(frame) AS e FROM touches GROUP BY ALL),
l AS (SELECT hits.*, s, e, lag(frame) OVER w AS pf, lag(grp) OVER w AS pg, lead(frame) OVER w AS nf, lead(grp) OVER w AS ng FROM hits JOIN grps USING (game, grp) WINDOW w AS (PARTITION BY game ORDER BY frame)),
b AS (SELECT game, frame, greatest(CASE WHEN pg = grp THEN pf ELSE s END, frame - 259200) AS lo, least(CASE WHEN ng = grp THEN nf ELSE e END, frame + 259200) AS hi FROM l),
n AS (SELECT b.game, frame, f, px, py, cx, cy, height, (f - frame) / 86400.0 AS t FROM b JOIN pts ON b.game = pts.game AND f BETWEEN lo AND hi),
a AS (SELECT game, frame, {_SIDES}, max(t) FILTER (f <= frame) AS t1, min(t) FILTER (f >= frame) AS t2 FROM n GROUP BY ALL HAVING count(*) FILTER (f <= frame) >= 4 AND count(*) FILTER (f >= frame) >= 4),
g AS (SELECT *, c_i = n_i AND c_o = n_o AS court, least(t1, t2) - 0.05 AS tl, greatest(greatest(t1, t2) + 0.05, least(t1, t2) - 0.05 + 1 / 240.0) AS th FROM a),
k AS (SELECT *, unnest(range(0, CAST(ceil((th - tl) / (1 / 240.0)) AS BIGINT))) AS k FROM g), m AS (SELECT *, tl + k * (1 / 240.0) AS best, CASE WHEN court THEN sqrt(pow(cx_i - cx_o + (vcx_i - vcx_o) * (tl + k * (1 / 240.0)), 2) + pow(cy_i - cy_o + (vcy_i - vcy_o) * (tl + k * (1 / 240.0)), 2)) ELSE sqrt(pow(px_i - px_o + (vpx_i - vpx_o) * (tl + k * (1 / 240.0)), 2) + pow(py_i - py_o + (vpy_i - vpy_o) * (tl + k * (1 / 240.0)), 2)) END AS gap FROM k),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY game, frame ORDER BY round(gap, 9), k) = 1),
c AS (SELECT game, frame, court, gap, (px_i + vpx_i * best + px_o + vpx_o * best) / 2 AS px, (py_i + vpy_i * best + py_o + vpy_o * best) / 2 AS py, CASE WHEN court THEN (cx_i + vcx_i * best + cx_o + vcx_o * best) / 2 END AS cx, CASE WHEN court THEN (cy_i + vcy_i * best + cy_o + vcy_o * best) / 2 END AS cy, frame / 86400.0 + best AS at_time,
 CASE WHEN court AND z_i >= 4 AND z_o >= 4 THEN (h_i + vh_i * best + h_o + vh_o * best) / 2 - 0.5 * 9.81 * best * best END AS height,
 CASE WHEN court THEN sqrt(vcx_i * vcx_i + vcy_i * vcy_i + CASE WHEN z_i >= 4 THEN pow(vh_i - 9.81 * best, 2) ELSE 0 END) ELSE sqrt(vpx_i * vpx_i + vpy_i * vpy_i) END AS si, CASE WHEN court THEN sqrt(vcx_o * vcx_o + vcy_o * vcy_o + CASE WHEN z_o >= 4 THEN pow(vh_o - 9.81 * best, 2) ELSE 0 END) ELSE sqrt(vpx_o * vpx_o + vpy_o * vpy_o) END AS so FROM o),
d AS (SELECT * FROM c WHERE gap <= CASE WHEN court THEN 1.0 ELSE 50.0 END AND (NOT court OR (si <= 45 AND so <= 45))), fr AS (SELECT DISTINCT game, frame AS f FROM touches),
q AS (SELECT d.game, d.frame, arg_min(f, abs(f - d.frame) * 2 + CASE WHEN f > d.frame THEN 1 ELSE 0 END) AS pf FROM d JOIN fr ON d.game = fr.game AND abs(f - d.frame) <= 43200 GROUP BY ALL),
ok AS (SELECT DISTINCT d.game, d.frame FROM d JOIN q USING (game, frame) JOIN touches t ON t.game = d.game AND t.frame = q.pf WHERE CASE WHEN court THEN sqrt(pow(cx - t.x, 2) + pow(cy - t.y, 2)) <= 2.5 ELSE sqrt(pow(px - t.x * 50, 2) + pow(py - t.y * 50, 2)) / 1000 <= 0.15 END)
SELECT hits.game, hits.frame, ok.frame IS NOT NULL AS refined, CASE WHEN ok.frame IS NOT NULL THEN round(px, 3) END AS px, CASE WHEN ok.frame IS NOT NULL THEN round(cy, 3) END AS cy, CASE WHEN ok.frame IS NOT NULL THEN round(height, 3) END AS height, CASE WHEN ok.frame IS NOT NULL THEN round(at_time, 4) END AS at_time, CASE WHEN ok.frame IS NOT NULL THEN round(si, 3) END AS speed_in, CASE WHEN ok.frame IS NOT NULL THEN round(so, 3) END AS speed_out FROM hits LEFT JOIN d USING (game, frame) LEFT JOIN ok USING (game, frame)""")
def refined_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Spikes moved to where the flights before and after meet; every third game has pixels only."""
    t = touches(spark, d)
    court = F.col("game") % 3 != 0
    pts = t.where(scalars.measured(F.col("touch_id") % 5 == 0, F.col("x"))).groupBy("game", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("height").alias("height"))
    pts = pts.select("game", "frame", (F.col("x") * 50).alias("px"), (F.col("y") * 50).alias("py"), F.when(court, F.col("x")).alias("cx"), F.when(court, F.col("y")).alias("cy"), "height")
    grp = F.floor(F.col("rally") / 16)
    hits = t.where("action_type = 'spike' and touch_id % 4 = 0").groupBy("game", "frame").agg(F.min(grp).alias("grp"))
    ends = t.groupBy("game", grp.alias("grp")).agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    hits = contacts.flight_bounds(hits.join(ends, ["game", "grp"]), ["game"], "frame", "grp", "start", "end", 259_200)
    players = t.select("game", "frame", "x", "y", (F.col("x") * 50).alias("px"), (F.col("y") * 50).alias("py"))
    out = contacts.refined(hits, pts, players, ["game"], 86_400.0, 1000.0, near=43_200)
    return out.select("game", "frame", "refined", F.round("at_px", 3).alias("px"), F.round("at_cy", 3).alias("cy"), F.round("at_height", 3).alias("height"), F.round("at_time", 4).alias("at_time"), F.round("speed_in", 3).alias("speed_in"), F.round("speed_out", 3).alias("speed_out"))


_DET = lambda v: (  # noqa: E731 - Cramer's rule over power sums
    f"({v}2 * (s2 * s0 - s1 * s1) - s3 * ({v}1 * s0 - s1 * {v}0) + s2 * ({v}1 * s1 - s2 * {v}0)) / det AS a{v}, (s4 * ({v}1 * s0 - s1 * {v}0) - {v}2 * (s3 * s0 - s1 * s2) + s2 * (s3 * {v}0 - {v}1 * s2)) / det AS b{v}, (s4 * (s2 * {v}0 - {v}1 * s1) - s3 * (s3 * {v}0 - {v}1 * s2) + {v}2 * (s3 * s1 - s2 * s2)) / det AS c{v}"
)


@query(f"""WITH {TOUCHES}, p AS (SELECT game, player, rally // 8 AS part, (frame - min(frame) OVER (PARTITION BY game, player, rally // 8)) / 86400.0 AS t, x * 50 AS px, 400 - coalesce(height, 0) * 60 AS py FROM touches),
s AS (SELECT game, player, part, min(t) AS b0, max(t) AS e0, count(*) AS n, sum(pow(t, 4)) AS s4, sum(pow(t, 3)) AS s3, sum(pow(t, 2)) AS s2, sum(t) AS s1, count(*) AS s0, sum(pow(t, 2) * px) AS x2, sum(t * px) AS x1, sum(px) AS x0, sum(pow(t, 2) * py) AS y2, sum(t * py) AS y1, sum(py) AS y0 FROM p GROUP BY ALL HAVING count(*) >= 5 AND max(t) - min(t) >= 0.15),
f AS (SELECT *, {_DET('x')}, {_DET('y')} FROM (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det FROM s) WHERE abs(det) > 1e-12),
g AS (SELECT *, CASE WHEN ay > 0 THEN least(e0, greatest(b0, -by / (2 * ay))) END AS top FROM f), v AS (SELECT *, ay * top * top + by * top + cy AS vt, ay * b0 * b0 + by * b0 + cy AS vb, ay * e0 * e0 + by * e0 + cy AS ve FROM g),
i AS (SELECT *, by * by - 4 * ay * (cy - (vb + vt) / 2) AS d1, by * by - 4 * ay * (cy - (ve + vt) / 2) AS d2 FROM v),
c AS (SELECT *, CASE WHEN ay > 0 THEN CASE WHEN d1 >= 0 THEN least(greatest((-by - sqrt(greatest(d1, 0))) / (2 * ay), b0), top) ELSE b0 END ELSE b0 END AS b1, CASE WHEN ay > 0 THEN CASE WHEN d2 >= 0 THEN greatest(least((-by + sqrt(greatest(d2, 0))) / (2 * ay), e0), top) ELSE e0 END ELSE e0 END AS e1 FROM i),
w AS (SELECT *, CASE WHEN e1 > b1 THEN b1 ELSE b0 END AS "begin", CASE WHEN e1 > b1 THEN e1 ELSE e0 END AS finish FROM c), e AS (SELECT game, player, part, avg(sqrt(pow(p.px - (ax * t * t + bx * t + cx), 2) + pow(p.py - (ay * t * t + by * t + cy), 2))) AS err, count(*) AS shown FROM p JOIN w USING (game, player, part) WHERE t BETWEEN "begin" AND finish GROUP BY ALL)
SELECT w.game, w.player, w.part, round(ay, 4) AS a, round("begin", 4) AS "begin", round(finish, 4) AS finish FROM w LEFT JOIN e USING (game, player, part) WHERE NOT coalesce(shown >= 3 AND err > 0.01 * 30000, false)""".replace("by *", "\"by\" *").replace("* by", "* \"by\"").replace("-by", "-\"by\"").replace("AS by", "AS \"by\""))
def drawn_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Parabolas through a player's touches of eight rallies, cut half way up; y grows downwards."""
    part = F.floor(F.col("rally") / 8)
    t = touches(spark, d).withColumn("part", part)
    w = Window.partitionBy("game", "player", "part")
    p = t.select("game", "player", "part", ((F.col("frame") - F.min("frame").over(w)) / 86_400.0).alias("t"), (F.col("x") * 50).alias("px"), (400 - F.coalesce("height", F.lit(0.0)) * 60).alias("py"))
    out = contacts.arcs(p, ["game", "player", "part"], "t", "px", "py", 30_000.0)
    return out.select("game", "player", F.col("part").cast("long").alias("part"), F.round("ay", 4).alias("a"), F.round("begin", 4).alias("begin"), F.round("finish", 4).alias("finish"))


@query("""WITH p AS (SELECT l_orderkey AS game, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linestatus = 'F' THEN l_quantity * 40 ELSE l_quantity / 4 END AS gap, CASE WHEN l_returnflag <> 'N' THEN l_discount * 30 END AS metres, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 11 END AS zone, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount * 3 END AS look, l_quantity / 50 AS moved, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' END AS sa, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS sb, l_tax * 10 + 0.2 AS ca, l_discount * 8 + 0.2 AS cb FROM lineitem),
c AS (SELECT *, coalesce(sa <> sb, false) AS differ FROM p), b AS (SELECT *, CASE WHEN zone IS NULL THEN 0.85 * look + 0.15 * least(1.0, moved / (1 + gap / 25)) ELSE 0.45 * look + 0.40 * zone + 0.15 * least(1.0, moved / (1 + gap / 25)) END + CASE WHEN differ THEN 0.35 * least(ca, cb) ELSE 0 END AS blend FROM c)
SELECT game, line, part, round(CASE WHEN differ AND ca >= 0.7 AND cb >= 0.7 THEN NULL WHEN gap > 1800 THEN NULL WHEN gap <= 15 AND metres <= 1.0 THEN 0.05 * metres WHEN zone > 0.85 OR look IS NULL OR look > 0.22 OR blend > 0.45 THEN NULL ELSE blend END, 6) AS cost FROM b""")
def merge_costs(spark: SparkSession, d: str) -> DataFrame:
    """What merging two clusters costs, with unknown places, looks and sides."""
    c = F.col
    side = F.when(c("l_returnflag") == "A", "A").when(c("l_returnflag") == "R", "B")
    cost = detection.merge_cost(F.when(c("l_linestatus") == "F", c("l_quantity") * 40).otherwise(c("l_quantity") / 4), F.when(c("l_returnflag") != "N", c("l_discount") * 30), F.when(c("l_linenumber") % 3 != 0, c("l_tax") * 11), F.when(c("l_linenumber") % 5 != 0, c("l_discount") * 3), c("l_quantity") / 50, side, c("l_tax") * 10 + 0.2, F.when(c("l_linestatus") == "F", "A").otherwise("B"), c("l_discount") * 8 + 0.2)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("game"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), r6(cost, "cost"))


@query("""WITH p AS (SELECT l_orderkey AS game, l_linenumber AS line, l_partkey AS part, l_quantity * 60 AS gap, l_discount * 3 AS app, CASE WHEN l_returnflag = 'R' THEN l_tax * 10 END AS opp FROM lineitem), c AS (SELECT *, 0.85 * app + 0.15 * least(1.0, gap / 1800.0) + CASE WHEN opp IS NOT NULL THEN 0.35 * opp ELSE 0 END AS cost FROM p)
SELECT game, line, part, round(CASE WHEN gap <= 1800 AND app <= 0.22 AND coalesce(opp, 0) < 0.7 AND cost <= 0.45 THEN cost END, 6) AS cost FROM c""")
def pair_costs_uncalibrated(spark: SparkSession, d: str) -> DataFrame:
    """Pair costs of games whose court is not known."""
    c = F.col
    cost = detection.pair_cost(c("l_quantity") * 60, F.lit(None).cast("double"), F.lit(None).cast("double"), c("l_discount") * 3, F.when(c("l_returnflag") == "R", c("l_tax") * 10), calibrated=False)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("game"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), r6(cost, "cost"))


@query(f"""WITH {_CAND}, k AS (SELECT * FROM cand WHERE (game % 2 = 1 OR (x BETWEEN 5 AND 40 AND y BETWEEN 0 AND 8)) AND sqrt(w * w + h * h) >= 19), f AS (SELECT *, row_number() OVER (PARTITION BY game, frame ORDER BY conf DESC, id) AS k FROM k), p AS (SELECT game, count(*) AS n, avg(w) AS mw, stddev_pop(w) AS sw, avg(h) AS mh, stddev_pop(h) AS sh FROM f WHERE k = 1 AND conf >= 0.6 GROUP BY game HAVING count(*) >= 30),
o AS (SELECT k.*, CASE WHEN n IS NOT NULL THEN greatest(0.0, greatest(0.0, mw - 1.5 * sw) - w, w - (mw + 1.5 * sw)) + greatest(0.0, greatest(0.0, mh - 1.5 * sh) - h, h - (mh + 1.5 * sh)) ELSE 0 END AS off FROM k LEFT JOIN p USING (game)),
b AS (SELECT *, row_number() OVER (PARTITION BY game, frame ORDER BY round(off, 9), conf DESC, id) AS k FROM o) SELECT game, frame, CASE WHEN conf >= 0.6 THEN id END AS id FROM b WHERE k = 1""")
def reselected_ball(spark: SparkSession, d: str) -> DataFrame:
    """The ball picked anew from raw candidates under another region of interest, which every second game has."""
    raw = _cand(spark, d)
    bounds = [F.lit(v).alias(n) for n, v in (("x1", 5.0), ("y1", 0.0), ("x2", 40.0), ("y2", 8.0))]
    roi = raw.select("game").distinct().where("game % 2 = 0").select("game", *bounds)
    return detection.reselected(raw, roi, "game", "frame", "id", "w", "h", "conf", "x", "y", 19.0)


_H = spatial.homography([(0.0, 0.0), (18.0, 0.0), (18.0, 9.0), (0.0, 9.0)], [(-4.0, -2.0), (25.0, -1.0), (21.0, 12.0), (-1.0, 10.0)])
_AT = "(" + " + ".join(("{0} * x", "{1} * y", "{2}")) + ")"
_W = f"({_H[6]} * x + {_H[7]} * y + {_H[8]})"


@query(f"""WITH {TOUCHES}, q AS (SELECT game, player, {_AT.format(*_H[0:3])} / {_W} AS u, {_AT.format(*_H[3:6])} / {_W} AS v FROM touches), o AS (SELECT game, player FROM q GROUP BY ALL HAVING avg(CASE WHEN u BETWEEN -5 AND 23 AND v BETWEEN -1.5 AND 10.5 THEN 1.0 ELSE 0.0 END) < 0.9), i AS (SELECT DISTINCT game, player FROM touches WHERE player % 7 = 3)
SELECT game, player, false AS newly FROM i UNION ALL SELECT game, player, true FROM (SELECT * FROM o EXCEPT SELECT * FROM i)""")
def recalibrated_players(spark: SparkSession, d: str) -> DataFrame:
    """Places projected anew by another calibration, and the players ignored after it."""
    t = touches(spark, d)
    u, v = scalars.project(_H, F.col("x"), F.col("y"))
    share = F.avg(F.when(scalars.in_court_range(u, v), 1.0).otherwise(0.0))
    out = t.groupBy("game", "player").agg(share.alias("s")).where("s < 0.9")
    return members.ignored_changes(out, t.where("player % 7 = 3"), ["game", "player"])


@query(f"""WITH {_WON}, w AS (SELECT game, min(frame) + 86400 AS lo FROM touches GROUP BY game), k AS (SELECT t.*, CASE WHEN player % 11 <> 0 THEN 'p' || CAST(player % 6 AS VARCHAR) END AS name FROM touches t JOIN w USING (game) WHERE t.frame >= lo),
e AS (SELECT *, CASE WHEN frame = max(frame) OVER (PARTITION BY game, rally) THEN 1 ELSE 0 END AS ends FROM k), s AS (SELECT game, player, any_value(name) AS name, count(*) AS hits, count(*) FILTER (action_type = 'spike') AS spikes, count(DISTINCT rally) AS rallies, sum(ends) AS ends, CASE WHEN avg(x) < 9.0 THEN 'A' ELSE 'B' END AS side, strftime(to_timestamp(min(frame)), '%Y-%m-%d') AS day FROM e GROUP BY ALL),
m AS (SELECT game, CASE WHEN count(*) FILTER (winner = 'A') > count(*) FILTER (winner = 'B') THEN 'A' WHEN count(*) FILTER (winner = 'B') > count(*) FILTER (winner = 'A') THEN 'B' END AS w FROM won GROUP BY game),
g AS (SELECT s.*, CASE WHEN w = side THEN 'win' WHEN w <> side THEN 'loss' ELSE '' END AS result FROM s JOIN m USING (game) WHERE name IS NOT NULL),
r AS (SELECT name, round(avg(CASE WHEN won.winner = g.side THEN 1.0 ELSE 0.0 END), 6) AS spike_rate FROM e JOIN g USING (game, player, name) JOIN won ON won.game = e.game AND won.rally = e.rally WHERE action_type = 'spike' GROUP BY ALL)
SELECT g.name, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(spikes) AS BIGINT) AS spikes, CAST(sum(rallies) AS BIGINT) AS rallies, CAST(sum(ends) AS BIGINT) AS ending_touches, count(*) AS games, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, string_agg(day || ' ' || game || ' ' || result, ',' ORDER BY day DESC, game, player) AS listed, any_value(spike_rate) AS spike_rate FROM g LEFT JOIN r USING (name) GROUP BY g.name""")
def profile_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by name over games after their warm-up: sums, games from the latest on with results, and the rate of won spikes."""
    t = touches(spark, d)
    low = t.groupBy("game").agg((F.min("frame") + 86_400).alias("lo"))
    kept = t.join(low, "game").where(F.col("frame") >= F.col("lo")).drop("lo")
    name = F.when(F.col("player") % 11 != 0, F.concat(F.lit(" p"), (F.col("player") % 6).cast("string")))
    names = kept.select("game", "player", name.alias("name")).distinct()
    day = kept.groupBy("game", "player").agg(F.date_format(F.timestamp_seconds(F.min("frame")), "yyyy-MM-dd").alias("day"))
    mean = stats.ordered_mean(kept, ["game", "player"], "x", ["frame", "touch_id"], "x")
    side = day.join(mean, ["game", "player"], "left").select("game", "player", F.when(F.col("x") < 9.0, "A").otherwise("B").alias("side"), "day")
    won = _won(spark, d).select("game", "rally", "winner")
    m = won.groupBy("game").agg(stats.winner(F.count_if(F.col("winner") == "A"), F.count_if(F.col("winner") == "B"), "A", "B").alias("w"))
    own = members.with_names(stats.consolidated(kept), names, ["game", "player"]).join(side, ["game", "player"]).join(m, "game").where("name is not null")
    result = F.when(F.col("w") == F.col("side"), "win").when(F.col("w") != F.col("side"), "loss").otherwise("")
    rate = kept.where("action_type = 'spike'").join(own.select("game", "player", "name", "side"), ["game", "player"]).join(won, ["game", "rally"]).groupBy("name").agg(r6(F.avg(F.when(F.col("winner") == F.col("side"), 1.0).otherwise(0.0)), "spike_rate"))
    games = F.array_sort(F.collect_list(F.struct("day", "game", "player", result.alias("result"))), lambda a, b: F.when(a["day"] > b["day"], -1).when(a["day"] < b["day"], 1).when(a["game"] < b["game"], -1).when(a["game"] > b["game"], 1).when(a["player"] < b["player"], -1).otherwise(1))
    listed = F.array_join(F.transform(games, lambda g: F.concat_ws(" ", g["day"], g["game"].cast("string"), g["result"])), ",")
    out = own.groupBy("name").agg(F.sum("total_hits").alias("hits"), F.sum("n_spike").alias("spikes"), F.sum("rallies").alias("rallies"), F.sum("ending_touches").alias("ending_touches"), F.count("*").alias("games"), F.count_if(result == "win").alias("wins"), F.count_if(result == "loss").alias("losses"), listed.alias("listed"))
    return out.join(rate, "name", "left").select("name", "hits", "spikes", "rallies", "ending_touches", "games", "wins", "losses", "listed", "spike_rate")


_PAGE = f"""{SCORED}, won AS (SELECT game, rally, coalesce(lead(start_side) OVER (PARTITION BY game ORDER BY rally), CASE end_side WHEN 'A' THEN 'B' ELSE 'A' END) AS winner FROM (SELECT game, rally, CASE WHEN arg_min(x, (frame, touch_id)) < 9.0 THEN 'A' ELSE 'B' END AS start_side, CASE WHEN arg_max(x, (frame, touch_id)) < 9.0 THEN 'A' ELSE 'B' END AS end_side FROM touches GROUP BY game, rally)),
named AS (SELECT *, 'p' || CAST(player % 6 AS VARCHAR) AS name FROM touches WHERE player % 11 <> 0), ends AS (SELECT *, CASE WHEN frame = max(frame) OVER (PARTITION BY game, rally) THEN 1 ELSE 0 END AS is_end FROM touches),
s AS (SELECT game, player, 'p' || CAST(player % 6 AS VARCHAR) AS name, count(*) AS hits, count(DISTINCT rally) AS rallies, sum(is_end) AS ends, count(*) FILTER (action_type = 'spike') AS spikes, CASE WHEN game % 5 <> 0 THEN strftime(to_timestamp(min(frame)), '%Y-%m-%d') ELSE '' END AS day FROM ends WHERE player % 11 <> 0 GROUP BY game, player),
m AS (SELECT game, count(*) FILTER (winner = 'A') AS a, count(*) FILTER (winner = 'B') AS b FROM won GROUP BY game), r AS (SELECT game, CASE WHEN a > b THEN 'T' || (game % 3) WHEN b > a THEN 'T' || ((game + 1) % 3) END AS won, CASE WHEN a > b THEN 'T' || ((game + 1) % 3) WHEN b > a THEN 'T' || (game % 3) END AS lost FROM m),
g AS (SELECT s.*, CASE WHEN team = won THEN 'win' WHEN team = lost THEN 'loss' ELSE '' END AS result, coalesce(team, '') AS tname FROM (SELECT *, CASE WHEN player % 6 % 3 IN (game % 3, (game + 1) % 3) THEN 'T' || (player % 6 % 3) END AS team FROM s) s JOIN r USING (game)),
rad AS (SELECT name, string_agg(action_type || ' ' || wins || '/' || total, ',' ORDER BY action_type) AS radar FROM (SELECT name, action_type, count(*) AS total, sum(CASE WHEN winner = CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END THEN 1 ELSE 0 END) AS wins FROM named JOIN won USING (game, rally) GROUP BY ALL) GROUP BY name),
q AS (SELECT name, string_agg(action_type || ' ' || scored || '/' || n, ',' ORDER BY action_type) AS quality, round(sum(average), 4) AS averages FROM (SELECT 'p' || CAST(player % 6 AS VARCHAR) AS name, action_type, count(*) AS n, count(score) AS scored, avg(score) AS average FROM scored WHERE player % 11 <> 0 GROUP BY ALL) GROUP BY name)"""


@query(f"""WITH {_PAGE} SELECT g.name, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(spikes) AS BIGINT) AS spikes, CAST(sum(g.rallies) AS BIGINT) AS rallies, CAST(sum(ends) AS BIGINT) AS ending_touches, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, CAST(arg_min(player, (game, player)) FILTER (player % 4 = 1) AS VARCHAR) AS thumbnail,
string_agg(day || ' ' || game || ' ' || player || ' ' || tname || ' ' || result, ',' ORDER BY day DESC, game, player) AS games, any_value(radar) AS radar, any_value(quality) AS quality, any_value(averages) AS averages FROM g LEFT JOIN rad USING (name) LEFT JOIN q USING (name) GROUP BY g.name""")
def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole profiles by name: results by the name's team, radar, quality and thumbnail in the row."""
    t = touches(spark, d)
    name = F.when(F.col("player") % 11 != 0, F.concat(F.lit(" p"), (F.col("player") % 6).cast("string")))
    day = t.groupBy("game", "player").agg(F.date_format(F.timestamp_seconds(F.min("frame")), "yyyy-MM-dd").alias("day"))
    records = stats.consolidated(t).join(day, ["game", "player"]).withColumns({"name": name, "day": F.when(F.col("game") % 5 != 0, F.col("day"))})
    won = _won(spark, d).select("game", "rally", "winner")
    team = lambda k: F.concat(F.lit("T"), ((F.col("game") + k) % 3).cast("string"))
    a, b = F.count_if(F.col("winner") == "A"), F.count_if(F.col("winner") == "B")
    ends = won.groupBy("game").agg(stats.winner(a, b, "A", "B").alias("w")).select("game", F.when(F.col("w") == "A", team(0)).when(F.col("w") == "B", team(1)).alias("won"), F.when(F.col("w") == "A", team(1)).when(F.col("w") == "B", team(0)).alias("lost"))
    games = t.select("game").distinct()
    slots = games.select("game", F.lit(0).alias("slot"), team(0).alias("team")).unionByName(games.select("game", F.lit(1).alias("slot"), team(1).alias("team"))).withColumn("team_name", F.col("team"))
    rosters = spark.range(6).select(F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("team"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"))
    thumbs = records.select("game", "player", F.when(F.col("player") % 4 == 1, F.col("player").cast("string")).alias("thumbnail"))
    known = t.withColumn("name", F.trim(name)).where("name is not null")
    rate = known.join(won, ["game", "rally"]).groupBy("name", "action_type").agg(F.count("*").alias("total"), F.count_if(F.col("winner") == F.when(F.col("x") < 9.0, "A").otherwise("B")).alias("wins"))
    scored = stats.summary(quality.scored(wide(spark, d)).withColumn("name", F.trim(name)).where("name is not null"), ["name", "action_type"], "score")
    p = profiles.profiles(records, slots, rosters, ends, thumbs, rate, scored)
    line = F.array_join(F.transform("games", lambda g: F.concat_ws(" ", g["day"], g["game"].cast("string"), g["player"].cast("string"), F.coalesce(g["team"], F.lit("")), F.coalesce(g["result"], F.lit("")))), ",")
    short = lambda c, x, y: F.array_join(F.transform(c, lambda r: F.concat(r["action_type"], F.lit(" "), r[x].cast("string"), F.lit("/"), r[y].cast("string"))), ",")
    total = F.aggregate(F.filter("quality", lambda r: r["average"].isNotNull()), F.lit(0.0), lambda s, r: s + r["average"])
    return p.select("name", F.col("total_hits").alias("hits"), F.col("n_spike").alias("spikes"), "rallies", "ending_touches", "wins", "losses", "thumbnail", line.alias("games"), short("radar", "wins", "total").alias("radar"), short("quality", "scored", "n").alias("quality"), F.round(total, 4).alias("averages"))


@query(f"""WITH {SCORED} SELECT 'p' || CAST(player % 6 AS VARCHAR) AS name, action_type, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS average FROM scored WHERE player % 11 <> 0 GROUP BY ALL""")
def profile_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each name by category over all games."""
    t = quality.scored(wide(spark, d)).where("player % 11 <> 0").withColumn("name", F.concat(F.lit("p"), (F.col("player") % 6).cast("string")))
    return stats.summary(t, ["name", "action_type"], "score").withColumn("average", F.round("average", 6))


@query(f"WITH {SCORED}, s AS (SELECT game, {_mean({n: (c, _SERVE[n]) for n, c in _factors()['serve'].items()})} AS score FROM scored WHERE action_type = 'serve') SELECT game, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS average FROM s GROUP BY game")
def quality_resummarized(spark: SparkSession, d: str) -> DataFrame:
    """The summary of serves under weights of the caller's."""
    weights = scalars.redistributed(Params().weights("SERVE_WEIGHTS"), "placement", 0.6)
    t = quality.scored(wide(spark, d)).where("action_type = 'serve'")
    return stats.summary(t.withColumn("score", quality.reweighted(t, weights)), ["game"], "score").withColumn("average", F.round("average", 6))


def _review(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = touches(spark, d).withColumns({"hour": F.floor(F.col("frame") / 1800), "node": F.col("player") * 100 + F.col("rally") % 7})
    once = t.select("game", "rally", "node", "hour").distinct()
    a, b = once.select("game", "rally", F.col("node").alias("a")).distinct(), once.select("game", "rally", F.col("node").alias("b")).distinct()
    edges = a.join(b, ["game", "rally"]).where("a < b").groupBy("game", "a", "b").agg((F.count("*") / 50).alias("s"))
    names = once.select("game", "node", F.when(F.col("node") % 3 == 0, "ann").when(F.col("node") % 3 == 1, "bo").alias("name")).distinct()
    return graph.clique_groups(edges, "game", "a", "b", "s", shared=members.shared_frames(once, ["game"], "node", "hour").where("shared > 1"), names=names), names


@query()
def review_groups(spark: SparkSession, d: str) -> DataFrame:
    """Players who touch the ball in the same rallies, as groups that share no hour and no two names."""
    return _review(spark, d)[0]


@query()
def review_list(spark: SparkSession, d: str) -> DataFrame:
    """These groups with their members and a suggested name, the largest and surest of a game first."""
    groups, names = _review(spark, d)
    return members.review_list(groups, names, "game")
