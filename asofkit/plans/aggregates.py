"""Scans, set operations, joins, aggregates, ranks and bins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import audit, matching, ranking
from asofkit.operators.ledger import exact_sum
from asofkit.plans.asof import events, orders
from asofkit.plans.registry import query, read

_E = "epoch_us(ts) // 1000000"


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, (sum(round(l_extendedprice * 100)::BIGINT) FILTER (WHERE l_quantity >= 25))::BIGINT AS big_cents, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def filtered_aggs(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_quantity") >= 25, cents)).alias("big_cents"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM k) AS keys, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM k) AS surplus")
def count_distinct_tuple(spark, d):
    return audit.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 2")
def having_duplicates(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 2")


@query("SELECT event_type, hour(ts)::INT AS hour, dayofweek(ts)::INT AS dow, count(*) AS n FROM events GROUP BY ALL")
def group_by_clock(spark, d):
    return read(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(sum(TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(18,9)))::DOUBLE, 6) AS total FROM events GROUP BY ALL")
def decimal_money_sum(spark, d):
    """Money summed as decimals from text, cast once at the end."""
    return read(spark, d, "events").groupBy("event_type").agg(F.round(exact_sum(F.col("value").cast("string")).cast("double"), 6).alias("total"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ALL")
def quantile_profile(spark, d):
    p, r = F.col("o_totalprice"), lambda c, n: F.round(c, 4).alias(n)
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.avg(p), "mean"), r(F.median(p), "median"), r(F.stddev_samp(p), "std"), r(F.percentile(p, 0.75) - F.percentile(p, 0.25), "iqr"), r(F.percentile(p, 0.1), "p10"), r(F.percentile(p, 0.9), "p90"), F.min(p).alias("least"), F.max(p).alias("most"))


@query("SELECT l_shipdate AS at, l_orderkey AS id, 'item' AS kind FROM lineitem WHERE l_quantity > 49 UNION ALL BY NAME SELECT o_orderkey AS id, 'order' AS kind, o_orderdate AS at FROM orders WHERE o_totalprice > 400000")
def union_by_name(spark, d):
    a = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("id"), F.lit("item").alias("kind"))
    b = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    return a.unionByName(b)


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def intersect_keys(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, d, "events").select("user_id"))


@query("(SELECT 'left' AS side, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events)) UNION ALL (SELECT 'right' AS side, k FROM (SELECT user_id AS k FROM events EXCEPT SELECT o_custkey FROM orders))")
def except_keys(spark, d):
    """Coverage gaps both ways."""
    return audit.set_difference(read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def distinct_keys(spark, d):
    return read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') OR o_totalprice > 300000")
def semi_filter(spark, d):
    """IN a subquery under OR: an existence join."""
    buyers = read(spark, d, "events").where("event_type = 'purchase'").select("user_id").distinct().withColumn("buys", F.lit(True))
    o = read(spark, d, "orders")
    return o.join(buyers, o.o_custkey == buyers.user_id, "left").where(F.col("buys") | (F.col("o_totalprice") > 300000)).select("o_orderkey", "o_custkey")


@query("SELECT user_id AS k, value AS v, 'first' AS source FROM events WHERE event_type = 'purchase' UNION ALL SELECT o_custkey, o_totalprice, 'second' FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def anti_source_union(spark, d):
    """One source wins a key: the second gives only keys that the first lacks."""
    first = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.lit("first").alias("source"))
    second = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("second").alias("source"))
    return first.union(second.join(first.select("k").distinct(), "k", "left_anti").select("k", "v", "source"))


@query("WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY ALL), b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS items, (sum(round(l_extendedprice * 100)::BIGINT))::BIGINT AS cents FROM lineitem GROUP BY ALL) SELECT coalesce(a.month, b.month) AS month, coalesce(orders, 0) AS orders, coalesce(items, 0) AS items, coalesce(cents, 0) AS cents FROM a FULL JOIN b ON a.month = b.month")
def full_outer_month(spark, d):
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    a = read(spark, d, "orders").groupBy(month("o_orderdate")).agg(F.count("*").alias("orders"))
    b = read(spark, d, "lineitem").groupBy(month("l_shipdate")).agg(F.count("*").alias("items"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return a.join(b, "month", "full").fillna(0)


@query("SELECT s_suppkey, count(c_custkey) AS poorer FROM supplier LEFT JOIN customer ON c_acctbal < s_acctbal GROUP BY ALL")
def theta_left_join(spark, d):
    """A join on an inequality alone, over all suppliers and customers, by running counts instead of pairs."""
    return matching.count_below(read(spark, d, "supplier"), "s_suppkey", "s_acctbal", read(spark, d, "customer").where(F.col("c_custkey").isNotNull()), "c_acctbal", "poorer")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 7 = 0")
def hash_sample(spark, d):
    return read(spark, d, "orders").where(ranking.hash_pick(F.col("o_orderkey"), 7)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_score(spark, d):
    return ranking.top_k(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderpriority, o_totalprice FROM r WHERE r <= greatest(1, round_even(n * 0.01, 0))")
def topk_per_bucket(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.top_share_per_bucket(o, "o_orderpriority", "o_totalprice", "o_orderkey", 0.01)


@query("SELECT l_orderkey, l_linenumber, l_quantity, round((rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER (), 9) AS pr FROM lineitem")
def pct_rank_avg(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ranking.percent_rank_average(li, "l_quantity", "pr").select("l_orderkey", "l_linenumber", "l_quantity", F.round("pr", 9).alias("pr"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM orders) SELECT CASE WHEN o_totalprice <= e[2] THEN 0 WHEN o_totalprice <= e[3] THEN 1 WHEN o_totalprice <= e[4] THEN 2 WHEN o_totalprice <= e[5] THEN 3 ELSE 4 END AS bin, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders, q GROUP BY ALL")
def qcut_bins(spark, d):
    o = read(spark, d, "orders")
    edges = ranking.quantile_edges(o, "o_totalprice", 5)
    return o.groupBy(ranking.bin_by(F.col("o_totalprice"), edges).alias("bin")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def cut_bins(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.when(q <= 10, "small").when(q <= 30, "medium").otherwise("large").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS capped FROM orders, q")
def winsorize(spark, d):
    return ranking.winsorize(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05, 0.95, "capped").select("o_orderkey", F.round("capped", 4).alias("capped"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_corr(spark, d):
    return ranking.spearman(read(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


@query("WITH t AS (SELECT o_custkey, (sum(round(o_totalprice * 100)::BIGINT))::BIGINT AS c FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, o_custkey) AS r FROM t) SELECT round(max(c) / sum(c), 9) AS top_1, round((sum(c) FILTER (WHERE r <= 10)) / sum(c), 9) AS top_10 FROM r")
def top_share(spark, d):
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    top = ranking.top_k(t, "c", "o_custkey", 10).agg(F.max("c").alias("a"), F.sum("c").alias("b"))
    return t.agg(F.sum("c").alias("s")).crossJoin(F.broadcast(top)).select(F.round(F.col("a") / F.col("s"), 9).alias("top_1"), F.round(F.col("b") / F.col("s"), 9).alias("top_10"))


@query("SELECT count(*) AS rows, sum(('0x' || substr(sha256(concat_ws('|', coalesce(c_custkey::VARCHAR, '~'), coalesce(c_name, '~'), coalesce(c_nationkey::VARCHAR, '~'))), 1, 15))::BIGINT)::DECIMAL(38,0) AS checksum FROM customer")
def content_checksum(spark, d):
    return audit.checksum(read(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query(f"WITH g AS (SELECT user_id, {_E} AS t, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS h1, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS d1, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS everything FROM g) SELECT count(*) AS rows, count(*) FILTER (WHERE NOT h1 <= d1) AS hour_over_day, count(*) FILTER (WHERE NOT d1 <= everything) AS day_over_all FROM h")
def audit_monotone_windows(spark, d):
    """A wider window holds at least as much."""
    from asofkit.operators import history as H

    g = H.per_time(events(spark, d), ["user_id"], "t", {"n": F.count("*")})
    h = H.strict_prior(H.rolling(g, ["user_id"], "t", "n", {"h1": 3600, "d1": 86400}), ["user_id"], "t", {"everything": "n"})
    return audit.counts(h, {"hour_over_day": F.col("h1") <= F.col("d1"), "day_over_all": F.col("d1") <= F.col("everything")})


@query(f"""WITH g AS (SELECT o_custkey, epoch_us(o_orderdate) // 1000000 AS t, count(*) AS n FROM orders GROUP BY ALL), j AS (SELECT epoch_us(o.o_orderdate) // 1000000 AS moment, g.t AS t FROM orders o ASOF LEFT JOIN g ON o.o_custkey = g.o_custkey AND epoch_us(o.o_orderdate) // 1000000 > g.t)
SELECT count(*) AS rows, count(*) FILTER (WHERE t >= moment) AS future_states, count(*) FILTER (WHERE moment - t < 1) AS recency_under_1 FROM j""")
def audit_temporal(spark, d):
    """No state at or after its moment reached a row."""
    from asofkit.operators import asof as A
    from asofkit.operators import history as H

    o = orders(spark, d)
    g = H.per_time(o, ["o_custkey"], "t", {"n": F.count("*")})
    j = A.asof_join(o.select("o_orderkey", "o_custkey", F.col("t").alias("at")), g, ["o_custkey"], "at", "t", ["n"])
    return audit.counts(j, {"future_states": F.col("t") < F.col("at"), "recency_under_1": F.col("at") - F.col("t") >= 1})


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS idle, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty_orders")
def coverage_profile(spark, d):
    """Scalar subqueries as a cross join of one-row aggregates."""
    o, c, li = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "lineitem")
    a = o.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("buyers"))
    b = c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.count("*").alias("idle"))
    e = o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").agg(F.count("*").alias("empty_orders"))
    return a.crossJoin(b).crossJoin(e)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, (min(epoch_us(ts) // 1000000))::BIGINT AS first_t, (max(epoch_us(ts) // 1000000))::BIGINT AS last_t FROM events GROUP BY ALL")
def value_counts(spark, d):
    t = seconds(F.col("ts"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))


@query("WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, max(CASE WHEN a = 1 THEN event_id END) AS first_id, max(CASE WHEN b = 1 THEN event_id END) AS last_id FROM x GROUP BY ALL")
def keep_first_last(spark, d):
    key = F.struct("ts", "event_id")
    return read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", key).alias("first_id"), F.max_by("event_id", key).alias("last_id"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber))::VARCHAR AS lines, count(*) AS n FROM lineitem GROUP BY ALL")
def array_of_group(spark, d):
    lines = F.array_sort(F.collect_set("l_linenumber"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(lines, lambda x: x.cast("string")), ", "), F.lit("]")).alias("lines"), F.count("*").alias("n"))


@query("SELECT o_custkey, row_number() OVER w AS nth, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY nth <= 3")
def top_n_named_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", F.row_number().over(w).alias("nth"), "o_orderkey").where("nth <= 3")
