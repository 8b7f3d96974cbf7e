"""Ranking metrics, selection and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import evaluation as E
from asofkit.operators import learning, ranking
from asofkit.plans.asof import events
from asofkit.plans.registry import query, read

# score: an order's price in steps, label: whether it is urgent; many ties
_S = "s AS (SELECT o_orderkey AS id, round(o_totalprice / 5000)::BIGINT AS score, (o_orderpriority = '1-URGENT')::INT AS y FROM orders)"
_C = f"{_S}, g AS (SELECT score, count(*) AS n, sum(y)::BIGINT AS pos FROM s GROUP BY ALL), c AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(n - pos) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS p, (sum(n) OVER ())::BIGINT AS total FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def scored(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 5000).cast("long").alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


@query(f"WITH {_C} SELECT round(sum(pos / p * tp / (tp + fp)), 9) AS average_precision FROM c")
def average_precision(spark, d):
    return E.average_precision(scored(spark, d), "y", "score").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {_C} SELECT round(1 - sum(pos * (fp - (n - pos) / 2.0)) / max(p * (total - p)), 9) AS roc_auc FROM c")
def roc_auc(spark, d):
    return E.roc_auc(scored(spark, d), "y", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"WITH {_C}, t AS (SELECT score, tp / (tp + fp) AS precision, tp / p AS recall, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f1 FROM c), a AS (SELECT 'max_f1' AS rule, score, precision, recall FROM t ORDER BY round(f1, 12) DESC, score DESC LIMIT 1), b AS (SELECT 'recall_at_0.2' AS rule, score, precision, recall FROM t WHERE precision >= 0.2 ORDER BY recall DESC, score DESC LIMIT 1) SELECT rule, score AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM (FROM a UNION ALL FROM b)")
def threshold_search(spark, d):
    return E.best_threshold(scored(spark, d), "y", "score", [0.2]).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(f"WITH {_S}, q AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM s) SELECT greatest(len(list_filter(e, lambda x: x < score)) - 1, 0)::INT AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate FROM s, q GROUP BY ALL")
def calibration_bins(spark, d):
    return E.calibration(scored(spark, d), "y", "score", 10).withColumns({"mean_score": F.round("mean_score", 9), "rate": F.round("rate", 9)})


@query(f"WITH {_S}, r AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 500) SELECT round(avg(y), 9) AS precision, sum(y)::BIGINT AS hits FROM r")
def precision_at_k(spark, d):
    return E.precision_at_k(scored(spark, d), "y", "score", "id", 500).withColumn("precision", F.round("precision", 9))


@query(f"WITH {_S}, a AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 1000), b AS (SELECT a.*, c_acctbal FROM a JOIN orders ON o_orderkey = id JOIN customer ON c_custkey = o_custkey), r AS (SELECT id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 + rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / 2000 AS k FROM b) SELECT id, round(k, 9) AS k FROM r ORDER BY r.k DESC, id LIMIT 100")
def two_stage_selection(spark, d):
    """The best by one score, ranked again by the mean of the average-tie ranks of two."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    gate = ranking.top_k(scored(spark, d), "score", "id", 1000).join(o, "id").join(c, "o_custkey")
    both = ranking.average_rank(ranking.average_rank(gate, "score", "ra"), "c_acctbal", "rb").withColumn("k", (F.col("ra") + F.col("rb")) / 2000)
    return ranking.top_k(both.select("id", "k"), "k", "id", 100).withColumn("k", F.round("k", 9))


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s), n(k) AS (VALUES (100), (500), (1000), (2000)) SELECT k::BIGINT AS k, sum(y)::BIGINT AS hits, round(avg(y), 9) AS precision FROM r JOIN n ON r <= k GROUP BY ALL")
def frontier(spark, d):
    """Hits at several sizes, from one list of the largest size."""
    from pyspark.sql import Window

    sizes = [100, 500, 1000, 2000]
    top = ranking.top_k(scored(spark, d), "score", "id", max(sizes)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    n = F.explode(F.array(*[F.lit(k).cast("long") for k in sizes])).alias("k")
    return top.select("*", n).where("r <= k").groupBy("k").agg(F.sum("y").alias("hits"), F.round(F.avg("y"), 9).alias("precision"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg((event_type = 'purchase')::INT), 9) AS rate, round(avg((value > 50)::INT) FILTER (WHERE event_type = 'purchase'), 9) AS precision FROM events GROUP BY ALL")
def daily_stability(spark, d):
    buy = F.col("event_type") == "purchase"
    e = read(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(buy.cast("int")), 9).alias("rate"), F.round(F.avg(F.when(buy, (F.col("value") > 50).cast("int"))), 9).alias("precision"))


def _training(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return learning.prepare(o.join(c, "o_custkey", "left"), ["o_totalprice", "c_acctbal"], "label")


@query()
def ml_logistic(spark, d):
    rows = _training(spark, d)
    return learning.predict(learning.fit(rows, ["o_totalprice", "c_acctbal"], "label"), rows).select("id", "label", "score")


@query()
def ml_gbt(spark, d):
    rows = _training(spark, d)
    return learning.predict(learning.fit(rows, ["o_totalprice", "c_acctbal"], "label", "gbt"), rows).select("id", "label", "score")


@query()
def permutation_importance(spark, d):
    """Loss of average precision when a column is dealt anew."""
    rows = _training(spark, d)
    model = learning.fit(rows, ["o_totalprice", "c_acctbal"], "label")
    base = E.average_precision(learning.predict(model, rows), "label", "score").select(F.col("average_precision").alias("base"))
    out = None
    for c in ("o_totalprice", "c_acctbal"):
        got = E.average_precision(learning.predict(model, learning.permuted(rows, c, "id", "salt")), "label", "score")
        one = got.crossJoin(base).select(F.lit(c).alias("feature"), (F.col("base") - F.col("average_precision")).alias("importance"))
        out = one if out is None else out.union(one)
    return out


@query("WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS y FROM events GROUP BY ALL) SELECT CASE WHEN n <= 50 THEN 'few' WHEN n <= 70 THEN 'some' ELSE 'many' END AS history, count(*) AS users, sum(y)::BIGINT AS buys, round(sum(y) / sum(n), 9) AS rate FROM e GROUP BY ALL")
def subgroup_metrics(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("y"))
    return g.groupBy(F.when(F.col("n") <= 50, "few").when(F.col("n") <= 70, "some").otherwise("many").alias("history")).agg(F.count("*").alias("users"), F.sum("y").alias("buys"), F.round(F.sum("y") / F.sum("n"), 9).alias("rate"))


@query(f"""WITH {_C}, t AS (SELECT score, tp / (tp + fp) AS precision, tp / p AS recall FROM c), f(least) AS (VALUES (0.15::DOUBLE), (0.2::DOUBLE), (0.21::DOUBLE)),
r AS (SELECT least, score, precision, recall, row_number() OVER (PARTITION BY least ORDER BY recall DESC, score DESC) AS n FROM t JOIN f ON precision >= least) SELECT 'recall_at_' || least AS rule, score AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r WHERE n = 1""")
def thresholds_at_floors(spark, d):
    """The threshold of largest recall at each of several least precisions."""
    got = E.best_threshold(scored(spark, d), "y", "score", [0.15, 0.2, 0.21]).where("rule <> 'max_f1'")
    return got.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query("""WITH s AS (SELECT o_orderkey AS id, round(o_totalprice / 5000)::BIGINT AS price, (o_custkey % 997)::BIGINT AS customer, (o_orderpriority = '1-URGENT')::INT AS y FROM orders), q AS (SELECT 'price' AS policy, y, row_number() OVER (ORDER BY price DESC, id) AS r FROM s UNION ALL SELECT 'customer', y, row_number() OVER (ORDER BY customer DESC, id) FROM s UNION ALL SELECT 'both', y, row_number() OVER (ORDER BY price * 10 + customer DESC, id) FROM s), n(k) AS (VALUES (100), (500), (1000))
SELECT policy, k::BIGINT AS k, sum(y)::BIGINT AS hits, round(avg(y), 9) AS precision FROM q JOIN n ON r <= k GROUP BY ALL""")
def policy_frontier(spark, d):
    """Hits of several policies at several sizes: running counts of each policy's order, one pass a policy."""
    from asofkit.operators.ranking import running_totals

    s = scored(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 997).alias("customer")), "id")
    policies, sizes = {"price": F.col("score"), "customer": F.col("customer"), "both": F.col("score") * 10 + F.col("customer")}, [100, 500, 1000]
    out = None
    for name, score in policies.items():
        top = running_totals(s.select("id", "y", score.alias("v")), "v", {"r": F.lit(1)}, ["id"], descending=True).where(F.col("r") <= max(sizes))
        one = top.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in sizes])).alias("k")).where("r <= k").groupBy("k").agg(F.sum("y").alias("hits"), F.round(F.avg("y"), 9).alias("precision")).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
