"""Histories and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import asof as A
from asofkit.operators import history as H
from asofkit.plans.registry import query, read

DAY = 86400
_E = "epoch_us(ts) // 1000000"
_O = "epoch_us(o_orderdate) // 1000000"


def orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", seconds(F.col("o_orderdate")).alias("t"))


def events(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"))


def hourly(spark, d):
    """Events a user and hour: a state with real ties before grouping."""
    rows = events(spark, d).withColumn("t", F.floor(F.col("t") / 3600) * 3600)
    return H.per_time(rows, ["user_id"], "t", {"n": F.count("*"), "cents": F.sum(F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long"))})


_HOURLY = f"hourly AS (SELECT user_id, ({_E}) // 3600 * 3600 AS t, count(*) AS n, sum(round(coalesce(value, 0) * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL)"
_STATE = f"{_HOURLY}, state AS (SELECT user_id, t, (sum(n) OVER w)::BIGINT AS total, (sum(cents) OVER w)::BIGINT AS spent FROM hourly WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))"


def _state(spark, d):
    return H.cumulative(hourly(spark, d), ["user_id"], "t", {"total": F.sum("n"), "spent": F.sum("cents")}).select("user_id", "t", "total", "spent")


@query(f"""WITH g AS (SELECT o_custkey, {_O} AS t, count(*) AS n FROM orders GROUP BY ALL),
h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior,
 coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN {30 * DAY} PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_30d,
 coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN {365 * DAY} PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_365d,
 t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t) AS recency FROM g)
SELECT o.o_orderkey, h.t, h.prior, h.prior_30d, h.prior_365d, h.recency FROM orders o JOIN h ON o.o_custkey = h.o_custkey AND {_O.replace('o_orderdate', 'o.o_orderdate')} = h.t""")
def history_features(spark, d):
    """History of each order's customer before it: per-second groups, strict prior counts, rolling windows, recency."""
    rows = orders(spark, d)
    g = H.per_time(rows, ["o_custkey"], "t", {"n": F.count("*")})
    h = H.strict_prior(g, ["o_custkey"], "t", {"prior": "n"})
    h = H.recency(H.rolling(h, ["o_custkey"], "t", "n", {"prior_30d": 30 * DAY, "prior_365d": 365 * DAY}), ["o_custkey"], "t")
    return rows.select("o_orderkey", "o_custkey", "t").join(h.drop("n"), ["o_custkey", "t"]).drop("o_custkey")


@query(f"SELECT o_custkey, {_O} AS t, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL")
def history_per_second(spark, d):
    return H.per_time(orders(spark, d), ["o_custkey"], "t", {"n": F.count("*"), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))})


@query(f"WITH {_STATE} SELECT e.event_id, s.t AS state_t, s.total, s.spent FROM events e ASOF LEFT JOIN state s ON e.user_id = s.user_id AND {_E} > s.t")
def asof_prior_state(spark, d):
    """Each event with its user's latest hourly state strictly before it."""
    e = events(spark, d).select("event_id", "user_id", F.col("t").alias("at"))
    return A.asof_join(e, _state(spark, d), ["user_id"], "at", "t", ["total", "spent"]).select("event_id", F.col("t").alias("state_t"), "total", "spent")


@query(f"WITH {_STATE} SELECT e.event_id, s.t AS state_t, s.total FROM events e ASOF LEFT JOIN state s ON e.user_id = s.user_id AND {_E} - 7200 > s.t")
def asof_with_lag(spark, d):
    """The state that had been known for two hours."""
    e = events(spark, d).select("event_id", "user_id", F.col("t").alias("at"))
    return A.asof_join(e, _state(spark, d), ["user_id"], "at", "t", ["total"], lag=7200).select("event_id", F.col("t").alias("state_t"), "total")


@query(f"""WITH {_STATE} SELECT e.event_id, coalesce(a.total, 0) AS total, coalesce(a.total, 0) - coalesce(b.total, 0) AS total_1d, coalesce(a.total, 0) - coalesce(c.total, 0) AS total_7d
FROM events e ASOF LEFT JOIN state a ON e.user_id = a.user_id AND {_E} > a.t ASOF LEFT JOIN state b ON e.user_id = b.user_id AND {_E} - {DAY} > b.t ASOF LEFT JOIN state c ON e.user_id = c.user_id AND {_E} - {7 * DAY} > c.t""")
def asof_multi_horizon(spark, d):
    """Rolling windows as differences of one cumulative state at several lags, in one pass."""
    e = events(spark, d).select("event_id", "user_id", F.col("t").alias("at"))
    got = A.asof_horizons(e, _state(spark, d), ["user_id"], "at", "t", ["total"], {"a_": 0, "b_": DAY, "c_": 7 * DAY})
    z = lambda c: F.coalesce(c, F.lit(0))
    return got.select("event_id", z("a_total").alias("total"), (z("a_total") - z("b_total")).alias("total_1d"), (z("a_total") - z("c_total")).alias("total_7d"))


@query(f"""WITH g AS (SELECT o_custkey, {_O} AS t, count(*) AS members, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL)
SELECT o.o_orderkey, g.t AS group_t, g.members, g.keys FROM orders o ASOF LEFT JOIN g ON o.o_custkey = g.o_custkey AND {_O} > g.t""")
def asof_tie_group(spark, d):
    """The latest earlier group of orders of one customer and second: ties collapsed before the join."""
    rows = orders(spark, d)
    g = H.per_time(rows, ["o_custkey"], "t", {"members": F.count("*"), "keys": F.sum("o_orderkey")})
    return A.asof_join(rows.select("o_orderkey", "o_custkey", F.col("t").alias("at")), g, ["o_custkey"], "at", "t", ["members", "keys"]).select("o_orderkey", F.col("t").alias("group_t"), "members", "keys")


@query(f"""WITH g AS (SELECT user_id, event_type, ({_E}) // 3600 * 3600 AS t, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, event_type, t, (sum(n) OVER (PARTITION BY user_id, event_type ORDER BY t))::BIGINT AS total FROM g)
SELECT e.event_id, s.total FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.event_type = s.event_type AND {_E} > s.t""")
def asof_two_key(spark, d):
    rows = events(spark, d)
    g = H.per_time(rows.withColumn("t", F.floor(F.col("t") / 3600) * 3600), ["user_id", "event_type"], "t", {"n": F.count("*")})
    s = H.cumulative(g, ["user_id", "event_type"], "t", {"total": F.sum("n")})
    return A.asof_join(rows.select("event_id", "user_id", "event_type", F.col("t").alias("at")), s, ["user_id", "event_type"], "at", "t", ["total"]).select("event_id", "total")


@query(f"""WITH {_HOURLY} SELECT user_id, t, (sum(n) OVER w)::BIGINT AS total, max(n) OVER w AS most, min(n) OVER w AS least,
 max(CASE WHEN cents > 5000 THEN t END) OVER w AS last_big, min(t) OVER (PARTITION BY user_id) AS first_t FROM hourly WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def state_cumulative(spark, d):
    """Cumulative sum, running extremes, a filtered running maximum and the partition's minimum."""
    from pyspark.sql import Window

    s = H.cumulative(hourly(spark, d), ["user_id"], "t", {"total": F.sum("n"), "most": F.max("n"), "least": F.min("n"), "last_big": F.max(F.when(F.col("cents") > 5000, F.col("t")))})
    return s.withColumn("first_t", F.min("t").over(Window.partitionBy("user_id"))).drop("n", "cents")


@query(f"""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, {_O} AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT l_partkey, t, count(*) AS n FROM x GROUP BY ALL), q AS (SELECT l_partkey, l_suppkey, t, count(*) AS n FROM x GROUP BY ALL),
pp AS (SELECT l_partkey, t, coalesce(sum(n) OVER (PARTITION BY l_partkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part_uses FROM p),
qq AS (SELECT l_partkey, l_suppkey, t, coalesce(sum(n) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pair_uses FROM q)
SELECT l_orderkey, l_partkey, l_suppkey, x.t, part_uses, pair_uses FROM x JOIN pp USING (l_partkey, t) JOIN qq USING (l_partkey, l_suppkey, t)""")
def entity_cooccurrence_history(spark, d):
    """How often a part, and a part of one supplier, was ordered strictly before."""
    x = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "t"), "l_orderkey")
    one = H.strict_prior(H.per_time(x, ["l_partkey"], "t", {"n": F.count("*")}), ["l_partkey"], "t", {"part_uses": "n"}).drop("n")
    two = H.strict_prior(H.per_time(x, ["l_partkey", "l_suppkey"], "t", {"n": F.count("*")}), ["l_partkey", "l_suppkey"], "t", {"pair_uses": "n"}).drop("n")
    return x.join(one, ["l_partkey", "t"]).join(two, ["l_partkey", "l_suppkey", "t"]).select("l_orderkey", "l_partkey", "l_suppkey", "t", "part_uses", "pair_uses")


@query(f"WITH g AS (SELECT user_id, {_E} AS t, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, t, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM g")
def stream_state(spark, d):
    """Prior counts by user kept as stream state; run over the events as one available batch, into a table in the shared folder."""
    from asofkit.sources.tables import shared_folder
    from asofkit.streaming.windows import running_state

    batch, folder = read(spark, d, "events"), shared_folder(spark, "stream")
    rows = spark.readStream.schema(batch.schema).parquet(d + "/events.parquet*").select("user_id", seconds(F.col("ts")).alias("sec"))
    out = running_state(rows, "user_id", "sec").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, t long, prior long").parquet(f"{folder}/rows")


@query(f"""WITH s AS (SELECT event_type, ({_E}) // 3600 * 3600 AS h FROM events), w AS (SELECT event_type, unnest([h - 7200, h - 3600, h]) AS start FROM s) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_windows(spark, d):
    """Counts over three hours, every hour."""
    from asofkit.streaming.windows import sliding

    return sliding(read(spark, d, "events"), "ts", "3 hours", "1 hour", ["event_type"]).withColumn("start", seconds(F.col("start")))


@query(f"SELECT ({_E}) // 21600 * 21600 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    from asofkit.streaming.windows import tumbling

    return tumbling(read(spark, d, "events"), "ts", "6 hours", ["event_type"]).withColumn("start", seconds(F.col("start")))
