"""Outcomes, profit, ledgers and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import ledger
from asofkit.plans.lifecycles import outcomes
from asofkit.plans.registry import ORACLE, query, read

_OUT = "x AS (" + ORACLE["delay_policy_outcomes"] + ")"
_PNL = "CASE WHEN forced = 1 THEN -2.1 ELSE ((1 + roi) * ((1 - {s}) / (1 + {s})) - 1) * 2 - 0.1 END"


@query(f"WITH {_OUT} SELECT delay, count(*) AS n, round(avg((forced = 0)::INT), 9) AS fill_rate, round(avg(({_PNL.format(s=0.0)} > 0)::INT), 9) AS hit_rate, round(median(roi), 9) AS median_roi, round(sum({_PNL.format(s=0.0)}), 4) AS total FROM x GROUP BY ALL")
def pnl_metrics(spark, d):
    """Stake 2, cost 0.1: fills, hits, median return and total a policy."""
    pnl = ledger.outcome_pnl(F.col("roi"), F.col("forced"), 2.0, 0.1)
    return outcomes(spark, d).withColumn("p", pnl).groupBy("delay").agg(F.count("*").alias("n"), F.round(F.avg((F.col("forced") == 0).cast("int")), 9).alias("fill_rate"), F.round(F.avg((F.col("p") > 0).cast("int")), 9).alias("hit_rate"), F.round(F.median("roi"), 9).alias("median_roi"), F.round(F.sum("p"), 4).alias("total"))


@query(f"WITH {_OUT}, g(s) AS (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) SELECT delay, s AS slippage, round(sum(CASE WHEN forced = 1 THEN -2.1 ELSE ((1 + roi) * (1 - s) / (1 + s) - 1) * 2 - 0.1 END), 4) AS total FROM x CROSS JOIN g GROUP BY ALL")
def slippage_grid(spark, d):
    grid = spark.sql("SELECT * FROM VALUES (0.0D), (0.01D), (0.05D) AS g(slippage)")
    s = F.col("slippage")
    p = F.when(F.col("forced") == 1, -2.1).otherwise(((1 + F.col("roi")) * (1 - s) / (1 + s) - 1) * 2 - 0.1)
    return outcomes(spark, d).crossJoin(F.broadcast(grid)).groupBy("delay", "slippage").agg(F.round(F.sum(p), 4).alias("total"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(round((o_totalprice - 150000) * 100)::BIGINT)::BIGINT AS c FROM orders GROUP BY ALL),
e AS (SELECT day, (sum(c) OVER (ORDER BY day))::BIGINT AS equity FROM m), p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY day)) AS peak FROM e) SELECT day, equity, peak::DOUBLE AS peak, (peak - equity)::DOUBLE AS drawdown FROM p""")
def equity_drawdown(spark, d):
    m = read(spark, d, "orders").groupBy(F.unix_date(F.to_date("o_orderdate")).alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum(F.round((F.col("o_totalprice") - 150000) * 100).cast("long")).alias("c"))
    return ledger.drawdown(m, ["n"], "c").select("day", "equity", "peak", "drawdown")


@query("""WITH t AS (SELECT l_orderkey, max(l_tax) AS tax, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ALL)
SELECT l_orderkey, cents, round(least(tax * 100, cents * 0.0125), 4) AS reported, round(cents * 0.0125 - least(tax * 100, cents * 0.0125), 4) AS rest, round(cents * 0.0125, 4) AS total FROM t""")
def fee_ledger(spark, d):
    """A charge stated on every row of a transaction, taken once and bounded by the rate."""
    li = read(spark, d, "lineitem")
    once = ledger.charge_once(li, "l_orderkey", "l_tax", "tax")
    cents = li.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    part, rest, total = ledger.route_fee(F.col("tax") * 100, F.col("cents"), 0.0125)
    return once.join(cents, "l_orderkey").select("l_orderkey", "cents", F.round(part, 4).alias("reported"), F.round(rest, 4).alias("rest"), F.round(total, 4).alias("total"))


@query("""WITH x AS (SELECT l_partkey, l_returnflag AS f, epoch_us(l_shipdate) // 1000000 AS t, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem),
g AS (SELECT l_partkey, (sum(c) FILTER (WHERE f <> 'R'))::BIGINT AS paid, (sum(c) FILTER (WHERE f = 'R'))::BIGINT AS got, min(t) FILTER (WHERE f <> 'R') AS first_buy, max(t) FILTER (WHERE f = 'R') AS last_sell, count(*) FILTER (WHERE f = 'R') AS sells FROM x GROUP BY ALL)
SELECT l_partkey, paid, got, coalesce(got, 0) - coalesce(paid, 0) AS pnl, last_sell - first_buy AS hold, sells FROM g WHERE paid IS NOT NULL""")
def token_position_metrics(spark, d):
    """Positions: paid, got, profit, and time from the first buy to the last sale."""
    li = read(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("sell"), seconds(F.col("l_shipdate")).alias("t"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    buy, sell = lambda x: F.when(~F.col("sell"), x), lambda x: F.when(F.col("sell"), x)
    g = li.groupBy("l_partkey").agg(F.sum(buy(F.col("c"))).alias("paid"), F.sum(sell(F.col("c"))).alias("got"), F.min(buy(F.col("t"))).alias("first"), F.max(sell(F.col("t"))).alias("last"), F.count_if("sell").alias("sells"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return g.where("paid is not null").select("l_partkey", "paid", "got", (z("got") - z("paid")).alias("pnl"), (F.col("last") - F.col("first")).alias("hold"), "sells")


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def weekly_behavior(spark, d):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return read(spark, d, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query()
def market_replay(spark, d):
    """Each order's items as trades against one constant-product market."""
    from asofkit.operators.replay import Market, replay

    t = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_extendedprice") * 1000).cast("long").alias("amount"))
    return replay(t, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "amount"], Market(10**13, 10**15, 10**12, 8 * 10**14))
