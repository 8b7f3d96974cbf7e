"""Lifecycles, maturity, tied groups, relationships and first matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import after_position, ratio, seconds, shrunk_rate
from asofkit.operators import asof as A
from asofkit.operators import history as H
from asofkit.operators import lifecycle as L
from asofkit.operators import matching as M
from asofkit.plans.asof import DAY, events, orders
from asofkit.plans.registry import query, read

_E = "epoch_us(ts) // 1000000"
_O = "epoch_us(o_orderdate) // 1000000"
_S = "epoch_us(l_shipdate) // 1000000"
_LIFE = f"""e AS (SELECT event_id, user_id, event_type, {_E} AS t FROM events),
starts AS (SELECT user_id, t AS start FROM e WHERE event_type = 'signup' GROUP BY ALL),
life AS (SELECT s.user_id, s.start, min(p.t) AS outcome FROM starts s LEFT JOIN e p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.t > s.start GROUP BY ALL)"""
_UPDATES = f"""u AS (SELECT user_id, start AS t, 1 AS started, 0 AS matured, 0 AS succeeded FROM life UNION ALL
 SELECT user_id, start + {7 * DAY}, 0, 1, CASE WHEN outcome <= start + {7 * DAY} THEN 1 ELSE 0 END FROM life),
g AS (SELECT user_id, t, sum(started) AS started, sum(matured) AS matured, sum(succeeded) AS succeeded FROM u GROUP BY ALL),
state AS (SELECT user_id, t, (sum(started) OVER w)::BIGINT AS started, (sum(matured) OVER w)::BIGINT AS matured, (sum(succeeded) OVER w)::BIGINT AS succeeded FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t))"""


def items(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", seconds(F.col("l_shipdate")).alias("ship"))


def _life(spark, d):
    """Signups with the user's next purchase: as-of in reverse, the least later time."""
    e = events(spark, d)
    starts = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("start")).distinct()
    purchases = e.where("event_type = 'purchase'").select("user_id", "t")
    return M.first_match(starts, purchases, ["user_id"], F.col("t") > F.col("start"), [F.col("t")], ["t"], "o_").withColumnRenamed("o_t", "outcome")


def _state(spark, d):
    u = L.maturity_updates(_life(spark, d), "user_id", "start", "outcome", 7 * DAY)
    return H.cumulative(u, ["user_id"], "t", {c: F.sum(c) for c in ("started", "matured", "succeeded")})


@query(f"WITH {_LIFE} SELECT user_id, start, outcome FROM life")
def lifecycle_next_outcome(spark, d):
    return _life(spark, d)


@query(f"""WITH e AS (SELECT user_id, event_type, {_E} AS t FROM events), s AS (SELECT user_id, min(t) AS start FROM e WHERE event_type = 'signup' GROUP BY ALL),
p AS (SELECT user_id, min(t) AS f, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT s.user_id, start, CASE WHEN f > start THEN f END AS outcome_time, CASE WHEN f > start THEN n ELSE 0 END AS outcomes FROM s LEFT JOIN p USING (user_id)""")
def lifecycle_first_outcome(spark, d):
    """The first purchase of all counts only if it comes after the first signup."""
    e = events(spark, d)
    starts = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("start"))
    return L.first_outcome(starts, e.where("event_type = 'purchase'"), ["user_id"], "start", "t")


@query(f"WITH {_LIFE}, {_UPDATES} SELECT user_id, t, started, matured, succeeded FROM state")
def lifecycle_maturity_state(spark, d):
    return _state(spark, d).select("user_id", "t", "started", "matured", "succeeded")


@query(f"""WITH {_LIFE}, {_UPDATES} SELECT e.event_id, coalesce(started, 0) AS started, coalesce(matured, 0) AS matured, coalesce(succeeded, 0) AS succeeded,
 round(coalesce(succeeded, 0) / greatest(coalesce(matured, 0), 1), 9) AS rate, round(coalesce(succeeded, 0) / (coalesce(matured, 0) + 5), 9) AS shrunk, state.t IS NULL AS unknown
FROM e ASOF LEFT JOIN state ON e.user_id = state.user_id AND e.t > state.t""")
def lifecycle_features(spark, d):
    """Each event with its user's matured success rate strictly before it, raw and shrunken."""
    got = A.asof_join(events(spark, d).select("event_id", "user_id", F.col("t").alias("at")), _state(spark, d), ["user_id"], "at", "t", ["started", "matured", "succeeded"])
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("started", "matured", "succeeded")})
    s, m = F.col("succeeded"), F.col("matured")
    return got.select("event_id", "started", "matured", "succeeded", F.round(ratio(s, m), 9).alias("rate"), F.round(shrunk_rate(s, m, 5.0), 9).alias("shrunk"), F.col("t").isNull().alias("unknown"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, {_O} AS t FROM orders), s AS (SELECT l_orderkey, min({_S}) AS ship FROM lineitem GROUP BY ALL),
m AS (SELECT o_custkey, t, t + {60 * DAY} AS now, ship FROM o LEFT JOIN s ON l_orderkey = o_orderkey),
f AS (SELECT *, coalesce(ship < now AND ship <= t + {30 * DAY}, false) AS seen, t + {30 * DAY} < now AS mature FROM m)
SELECT o_custkey, t, now, count(*) AS group_size, round(avg(seen::INT), 9) AS observed, round(avg((mature AND NOT seen)::INT), 9) AS matured_without, round(avg((NOT mature AND NOT seen)::INT), 9) AS pending,
 median(CASE WHEN seen THEN ship - t END) AS median_delay FROM f GROUP BY ALL""")
def tied_group_summary(spark, d):
    """Orders of one customer and second as one group: shares shipped, matured without, pending, median delay."""
    ship = items(spark, d).groupBy("o_orderkey").agg(F.min("ship").alias("ship"))
    m = orders(spark, d).join(ship, "o_orderkey", "left").withColumn("now", F.col("t") + 60 * DAY)
    got = L.tied_group_features(m, ["o_custkey"], "t", "now", "ship", 30 * DAY)
    return got.withColumns({c: F.round(c, 9) for c in ("observed", "matured_without", "pending")})


@query(f"""SELECT o_orderkey, o_custkey, o_totalprice, {_O} AS t, count(l_orderkey) AS shipped_7d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND {_S} > {_O} AND {_S} <= {_O} + {7 * DAY} GROUP BY ALL""")
def outcome_interval_window(spark, d):
    return L.outcomes_within(orders(spark, d), items(spark, d), ["o_orderkey"], "t", "ship", 7 * DAY, "shipped_7d")


@query(f"""WITH e AS (SELECT user_id, event_type, {_E} AS t FROM events), b AS (SELECT user_id, t, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY ALL),
s AS (SELECT user_id, t, (sum(n) OVER (PARTITION BY user_id ORDER BY t))::BIGINT AS buys, min(t) OVER (PARTITION BY user_id) AS first_buy FROM b)
SELECT c.user_id, c.t, coalesce(s.buys, 0) AS buys, c.t - s.t AS since_last, c.t - s.first_buy AS since_first, coalesce(s.buys, 0) - coalesce(z.buys, 0) AS buys_1d
FROM (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'click') c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t > s.t ASOF LEFT JOIN s z ON c.user_id = z.user_id AND c.t - {DAY} > z.t""")
def relationship_features(spark, d):
    """For each click: purchases before it, time since the first and the last, and how many in the day before."""
    from pyspark.sql import Window

    e = events(spark, d)
    b = H.per_time(e.where("event_type = 'purchase'"), ["user_id"], "t", {"n": F.count("*")})
    s = H.cumulative(b, ["user_id"], "t", {"buys": F.sum("n")}).withColumn("first_buy", F.min("t").over(Window.partitionBy("user_id")))
    c = e.where("event_type = 'click'").select("user_id", F.col("t").alias("at")).distinct()
    got = A.asof_horizons(c, s, ["user_id"], "at", "t", ["buys", "first_buy"], {"a_": 0, "b_": DAY})
    z = lambda x: F.coalesce(x, F.lit(0))
    at = F.col("at")
    return got.select("user_id", at.alias("t"), z("a_buys").alias("buys"), (at - F.col("a_t")).alias("since_last"), (at - F.col("a_first_buy")).alias("since_first"), (z("a_buys") - z("b_buys")).alias("buys_1d"))


@query(f"""WITH o AS (SELECT o_orderkey, {_O} AS t FROM orders), i AS (SELECT l_orderkey, l_linenumber, {_S} AS ship, l_extendedprice, l_quantity, l_partkey FROM lineitem)
SELECT o_orderkey, t, ship AS e_ship, l_linenumber AS e_l_linenumber, l_extendedprice AS e_l_extendedprice FROM o LEFT JOIN i ON l_orderkey = o_orderkey AND ship > t
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ship, l_linenumber, l_extendedprice, l_quantity, l_partkey) = 1""")
def first_match_entry(spark, d):
    """The first item shipped after the order."""
    o = orders(spark, d).select("o_orderkey", "t")
    order = [F.col(c) for c in ("ship", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")]
    return M.first_match(o, items(spark, d), ["o_orderkey"], F.col("ship") > F.col("t"), order, ["ship", "l_linenumber", "l_extendedprice"], "e_")


@query(f"""WITH o AS (SELECT o_orderkey, {_O} AS t FROM orders), i AS (SELECT l_orderkey, l_linenumber, {_S} AS ship, l_extendedprice, l_quantity, l_partkey FROM lineitem), p(delay) AS (VALUES (0), (10), (20)),
en AS (SELECT o_orderkey, delay, min({{s: ship, l: l_linenumber, p: l_extendedprice, q: l_quantity, k: l_partkey}}) AS e FROM o CROSS JOIN p JOIN i ON l_orderkey = o_orderkey WHERE CASE WHEN delay = 0 THEN ship > t ELSE ship >= t + delay * {DAY} END GROUP BY ALL),
ex AS (SELECT o_orderkey, delay, min({{s: ship, l: l_linenumber, p: l_extendedprice, q: l_quantity, k: l_partkey}}) AS x FROM en JOIN i ON l_orderkey = o_orderkey WHERE ship > e.s OR (ship = e.s AND l_linenumber > e.l) GROUP BY ALL),
en2 AS (SELECT o_orderkey, delay, e.p AS e_price, x.p AS x_price FROM en LEFT JOIN ex USING (o_orderkey, delay))
SELECT o_orderkey, delay, e_price, x_price, round(coalesce(x_price / e_price - 1, -1), 9) AS roi, CASE WHEN x_price IS NULL THEN 1 ELSE 0 END AS forced FROM en2""")
def delay_policy_outcomes(spark, d):
    """Entries under three delays and the next item after each; no exit is a total loss."""
    return outcomes(spark, d)


def outcomes(spark, d):
    policies = spark.sql("SELECT * FROM VALUES (0), (10), (20) AS p(delay)")
    left = orders(spark, d).select("o_orderkey", "t").crossJoin(F.broadcast(policies))
    order = [F.col(c) for c in ("ship", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")]
    due = F.when(F.col("delay") == 0, F.col("ship") > F.col("t")).otherwise(F.col("ship") >= F.col("t") + F.col("delay") * DAY)
    entry = M.first_match(left, items(spark, d), ["o_orderkey"], due, order, ["ship", "l_linenumber", "l_extendedprice"], "e_", "inner")
    entry = entry.select("o_orderkey", "delay", "e_ship", "e_l_linenumber", F.col("e_l_extendedprice").alias("e_price"))
    later = after_position(F.col("ship"), F.col("l_linenumber"), F.col("e_ship"), F.col("e_l_linenumber"))
    both = M.first_match(entry, items(spark, d), ["o_orderkey"], later, order, ["l_extendedprice"], "x_")
    price = F.col("x_l_extendedprice")
    return both.select("o_orderkey", "delay", "e_price", price.alias("x_price"), F.round(F.coalesce(price / F.col("e_price") - 1, F.lit(-1.0)), 9).alias("roi"), price.isNull().cast("int").alias("forced"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, {_O} AS t FROM orders), r AS (SELECT c.c_custkey, o.o_orderkey, abs(o.t - 900000000) AS dt FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey)
SELECT c_custkey, o_orderkey, dt FROM r QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dt NULLS LAST, o_orderkey NULLS LAST) = 1""")
def nearest_match(spark, d):
    """Each customer's order nearest to a moment."""
    o = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.abs(F.col("t") - 900000000).alias("dt"))
    return M.nearest_match(read(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], ["c_custkey"], [F.col("dt"), F.col("o_orderkey")])


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_E} AS t FROM events), b AS (SELECT user_id, min(t) AS first_buy FROM e WHERE event_type = 'purchase' GROUP BY ALL), s AS (SELECT user_id, min(t) AS first_view FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, first_view, first_buy, first_buy - first_view AS latency FROM b JOIN s USING (user_id)""")
def latency_first_buy(spark, d):
    e = events(spark, d)
    first = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("t").alias(name))
    return first("purchase", "first_buy").join(first("view", "first_view"), "user_id").select("user_id", "first_view", "first_buy", (F.col("first_buy") - F.col("first_view")).alias("latency"))


@query(f"""WITH g AS (SELECT user_id, {_E} // {DAY} AS day, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS buys, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL)
SELECT * FROM g WHERE clicks > 0 AND buys > 0""")
def pair_same_group(spark, d):
    """Days on which a user has both kinds."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    g = events(spark, d).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(kind("click").alias("clicks"), kind("purchase").alias("buys"), F.countDistinct("event_type").alias("kinds"))
    return g.where("clicks > 0 and buys > 0")
