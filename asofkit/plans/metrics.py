"""Metric bundles, selections by group, gates and fingerprints of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import selection as S
from asofkit.plans.asof import DAY, events
from asofkit.plans.evaluation import _C, _S, scored
from asofkit.plans.registry import query, read

_SHARES = """count(*) AS rows, sum(y)::BIGINT AS positives, count(*) FILTER (WHERE {t}) AS selected, count(*) FILTER (WHERE {t} AND y = 1) AS true_positives"""
_RATES = """round(positives / greatest(rows, 1), 9) AS prevalence, round(selected / greatest(rows, 1), 9) AS selected_rate, round(true_positives / greatest(selected, 1), 9) AS precision, round(true_positives / greatest(positives, 1), 9) AS recall,
 round(2 * true_positives / greatest(selected + positives, 1), 9) AS f1, round(CASE WHEN positives > 0 THEN true_positives / greatest(selected, 1) * rows / positives ELSE 0 END, 9) AS precision_lift"""


def _rounded(df):
    return df.withColumns({f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.simpleString() == "double"})


@query(f"""WITH {_C}, a AS (SELECT {_SHARES.format(t='score >= 50')} FROM s), m AS (SELECT sum(pos / p * tp / (tp + fp)) AS ap, 1 - sum(pos * (fp - (n - pos) / 2.0)) / max(p * (total - p)) AS auc FROM c)
SELECT rows, positives, selected, true_positives, {_RATES}, round(ap, 9) AS average_precision, round(auc, 9) AS roc_auc, round(ap * rows / positives, 9) AS average_precision_lift FROM a, m""")
def metric_bundle(spark, d):
    return _rounded(S.metric_bundle(scored(spark, d), "y", "score", 50))


@query(f"WITH {_S}, k AS (SELECT sum(y)::BIGINT AS k, avg(y) AS v FROM s), r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS n FROM s), g AS (SELECT k, v, sum(y)::BIGINT AS h FROM r, k WHERE n <= k GROUP BY ALL) SELECT k, h AS positives_at_k, round(h / k, 9) AS precision_at_k, round(h / k, 9) AS recall_at_k, round(h / k / v, 9) AS lift_at_k FROM g")
def precision_at_positives(spark, d):
    return _rounded(S.at_positives(scored(spark, d), "y", "score", "id"))


def _grouped(spark, d):
    """Scored orders with their customer's number of orders known before, or none, and the week."""
    from asofkit.functions.expressions import seconds
    from asofkit.operators import history as H

    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", seconds(F.col("o_orderdate")).alias("t"))
    prior = H.strict_prior(H.per_time(o, ["o_custkey"], "t", {"n": F.count("*")}), ["o_custkey"], "t", {"before": "n"}).drop("n")
    rows = scored(spark, d).join(o, "id").join(prior, ["o_custkey", "t"])
    return rows.withColumns({"known": F.when(F.col("before") > 0, "known").otherwise("cold"), "week": F.floor(F.col("t") / (7 * DAY))})


_G = f"""{_S}, o AS (SELECT o_orderkey AS id, o_custkey, epoch_us(o_orderdate) // 1000000 AS t FROM orders), f AS (SELECT o_custkey, min(t) AS first FROM o GROUP BY ALL),
g AS (SELECT s.*, CASE WHEN t > first THEN 'known' ELSE 'cold' END AS known, t // {7 * DAY} AS week FROM s JOIN o USING (id) JOIN f USING (o_custkey))"""


@query(f"WITH {_G}, a AS (SELECT known, {_SHARES.format(t='score >= 50')} FROM g GROUP BY ALL) SELECT known, rows, positives, selected, true_positives, {_RATES} FROM a")
def known_and_cold(spark, d):
    """A selection's figures among customers with an earlier order and without."""
    return _rounded(S.selection_metrics(_grouped(spark, d), "y", F.col("score") >= 50, ["known"]))


@query(f"WITH {_G}, a AS (SELECT week, known, {_SHARES.format(t='score >= 50')} FROM g GROUP BY ALL) SELECT week, known, rows, positives, selected, true_positives, {_RATES} FROM a")
def weekly_known_and_cold(spark, d):
    return _rounded(S.selection_metrics(_grouped(spark, d), "y", F.col("score") >= 50, ["week", "known"]))


@query(f"WITH {_S}, h AS (SELECT *, ('0x' || substr(sha256(id || '|' || round_even(score * 1000, 0)::BIGINT), 1, 15))::BIGINT AS a, ('0x' || substr(sha256(id::VARCHAR), 1, 15))::BIGINT AS b FROM s) SELECT count(*) AS rows, count(*) FILTER (WHERE score >= 50) AS members, sum(a)::DECIMAL(38, 0) AS scores, (sum(b) FILTER (WHERE score >= 50))::DECIMAL(38, 0) AS membership FROM h")
def score_fingerprint(spark, d):
    """Fingerprints of all quantised scores and of the members of a selection, the same in any order of rows."""
    rows = scored(spark, d).withColumn("s", F.col("score") / 100000000)
    return S.score_fingerprint(rows, "id", "s", F.col("score") >= 50)


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events), v AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'view'), b AS (SELECT user_id, t, value FROM e WHERE event_type = 'purchase')
SELECT v.event_id, count(b.t) AS buys, coalesce(sum(round(b.value * 100)::BIGINT), 0)::BIGINT AS cents, (count(b.t) > 0)::INT AS label, max(m.last) < v.t + {7 * DAY} AS open FROM v LEFT JOIN b ON b.user_id = v.user_id AND b.t > v.t AND b.t <= v.t + {7 * DAY} CROSS JOIN (SELECT max(t) AS last FROM e) m GROUP BY v.event_id, v.t""")
def economic_label(spark, d):
    """Whether, and with how much, a view was followed by a purchase within 7 days; open where the data end before that."""
    e = events(spark, d)
    v = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("bt"), F.round(F.col("value") * 100).cast("long").alias("c"))
    end = e.agg(F.max("t").alias("last"))
    inside = (F.col("bt") > F.col("t")) & (F.col("bt") <= F.col("t") + 7 * DAY)
    got = v.join(b, "user_id", "left").groupBy("event_id", "t").agg(F.count_if(inside).alias("buys"), F.coalesce(F.sum(F.when(inside, F.col("c"))), F.lit(0)).alias("cents"))
    return got.crossJoin(F.broadcast(end)).select("event_id", "buys", "cents", (F.col("buys") > 0).cast("int").alias("label"), (F.col("last") < F.col("t") + 7 * DAY).alias("open"))


@query("""WITH x AS (SELECT l_quantity AS q, round(l_extendedprice / 1000)::BIGINT AS p, l_discount AS c FROM lineitem), r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS q, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS p, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS c FROM x WHERE q IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL)
SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 7) AS spearman FROM r UNION ALL SELECT 'q', 'c', round(corr(q, c), 7) FROM r UNION ALL SELECT 'p', 'c', round(corr(p, c), 7) FROM r""")
def spearman_matrix(spark, d):
    from asofkit.operators.ranking import spearman_matrix

    x = read(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.round(F.col("l_extendedprice") / 1000).cast("long").alias("p"), F.col("l_discount").alias("c"))
    return spearman_matrix(x, ["q", "p", "c"]).withColumn("spearman", F.round("spearman", 7))


@query("""WITH s AS (SELECT count(o_totalprice)::DOUBLE AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q, max(o_totalprice) AS hi FROM orders)
SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS measure, round(unnest([n, m, sd, lo, q[1], q[2], q[3], hi]), 4) AS value FROM s""")
def describe_column(spark, d):
    from asofkit.operators.ranking import describe

    return describe(read(spark, d, "orders"), "o_totalprice").withColumn("value", F.round("value", 4))


@query("SELECT column_name AS name, ordinal_position::INT AS position FROM information_schema.columns WHERE table_name = 'lineitem'")
def table_columns(spark, d):
    """The columns of a table, from its schema alone."""
    names = read(spark, d, "lineitem").columns
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, position int")


_TWO = "s AS (SELECT epoch_us(o_orderdate) // 1000000 // 604800 AS week, round(o_totalprice / 5000)::BIGINT AS a, (o_custkey % 40)::BIGINT AS b, (o_orderpriority = '1-URGENT')::INT AS y FROM orders)"


def _ap(x):
    return f"""g{x} AS (SELECT week, {x} AS score, count(*) AS n, sum(y)::BIGINT AS pos FROM s GROUP BY ALL), c{x} AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS taken, (sum(pos) OVER (PARTITION BY week))::BIGINT AS p FROM g{x} WINDOW w AS (PARTITION BY week ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a{x} AS (SELECT week, sum(pos / greatest(p, 1) * tp / taken) AS ap FROM c{x} GROUP BY ALL)"""


@query(f"WITH {_TWO}, {_ap('a')}, {_ap('b')} SELECT week, round(aa.ap, 9) AS first, round(ab.ap, 9) AS second, round(aa.ap - ab.ap, 9) AS delta FROM aa JOIN ab USING (week)")
def weekly_precision_deltas(spark, d):
    """Average precision of two scores by week, and by how much the first is ahead."""
    from asofkit.functions.expressions import seconds
    from asofkit.operators.regimes import average_precision_by

    o = read(spark, d, "orders")
    s = o.select(F.floor(seconds(F.col("o_orderdate")) / 604800).alias("week"), F.round(F.col("o_totalprice") / 5000).cast("long").alias("a"), (F.col("o_custkey") % 40).alias("b"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    one = lambda x, n: average_precision_by(s, "week", "y", x).select("week", F.col("average_precision").alias(n))
    return one("a", "first").join(one("b", "second"), "week").select("week", F.round("first", 9).alias("first"), F.round("second", 9).alias("second"), F.round(F.col("first") - F.col("second"), 9).alias("delta"))
