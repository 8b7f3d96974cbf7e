"""A score by period, threshold and feature bin; entries bound to a slot; models built on models; tables that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import audit, learning, promotion
from asofkit.operators import evaluation as E
from asofkit.operators import matching as M
from asofkit.operators import regimes as R
from asofkit.plans.asof import DAY, orders
from asofkit.plans.evaluation import _training
from asofkit.plans.lifecycles import items
from asofkit.plans.registry import query, read

_S = "s AS (SELECT o_orderkey AS id, o_custkey, epoch_us(o_orderdate) // 1000000 // 604800 AS week, year(o_orderdate)::INT AS year, round(o_totalprice / 5000)::BIGINT AS score, (o_orderpriority = '1-URGENT')::INT AS y FROM orders)"
_W = f"{_S}, g AS (SELECT week, score, count(*) AS n, sum(y)::BIGINT AS pos FROM s GROUP BY ALL), c AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS taken, (sum(pos) OVER (PARTITION BY week))::BIGINT AS p FROM g WINDOW w AS (PARTITION BY week ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def scored(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), "o_custkey", F.floor(seconds(F.col("o_orderdate")) / 604800).alias("week"), F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") / 5000).cast("long").alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


@query(f"WITH {_W} SELECT week, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives, round(sum(pos / greatest(p, 1) * tp / taken), 9) AS average_precision FROM c GROUP BY ALL")
def weekly_average_precision(spark, d):
    """Average precision of every week by itself."""
    return _rounded(R.average_precision_by(scored(spark, d), "week", "y", "score"), "average_precision")


@query(f"""WITH {_W}, f AS (SELECT *, round(2 * tp / greatest(taken + p, 1), 12) AS f1 FROM c),
a AS (SELECT week, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives, coalesce(sum(n) FILTER (WHERE score >= 50), 0)::BIGINT AS selected, coalesce(sum(pos) FILTER (WHERE score >= 50), 0)::BIGINT AS hits FROM c GROUP BY ALL),
b AS (SELECT week, score AS own_threshold, f1 AS own_f1 FROM f QUALIFY row_number() OVER (PARTITION BY week ORDER BY f1 DESC, score DESC) = 1)
SELECT a.*, round(hits / greatest(selected, 1), 9) AS precision, round(hits / greatest(positives, 1), 9) AS recall, round(2 * hits / greatest(selected + positives, 1), 9) AS f1, own_threshold, round(own_f1, 9) AS own_f1 FROM a JOIN b USING (week)""")
def weekly_regime(spark, d):
    """A week's figures at one frozen threshold, beside its own best threshold in hindsight."""
    return _rounded(R.regimes(scored(spark, d), "week", "y", "score", 50), "precision", "recall", "f1", "own_f1")


@query(f"""WITH {_S}, m(factor) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE), (1.25::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)),
a AS (SELECT year, factor, sum(y)::BIGINT AS positives, count(*) FILTER (WHERE score >= 30 * factor) AS selected, coalesce(sum(y) FILTER (WHERE score >= 30 * factor), 0)::BIGINT AS hits FROM s CROSS JOIN m GROUP BY ALL)
SELECT *, round(hits / greatest(selected, 1), 9) AS precision, round(hits / greatest(positives, 1), 9) AS recall FROM a""")
def threshold_sensitivity(spark, d):
    """Selections of each year at multiples of the threshold."""
    return _rounded(R.threshold_sensitivity(scored(spark, d), "year", "y", "score", 30.0, [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]), "precision", "recall")


@query(f"""WITH {_S}, x AS (SELECT s.*, c_acctbal FROM s JOIN customer ON c_custkey = o_custkey),
q AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM x),
b AS (SELECT greatest(len(list_filter(e, lambda v: v < c_acctbal)) - 1, 0)::INT AS bin, count(*) AS n, avg(y) AS rate, avg(score) AS mean_prediction FROM x, q GROUP BY ALL),
k AS (SELECT corr(bin, r) AS c FROM (SELECT bin, rank() OVER (ORDER BY mean_prediction) + (count(*) OVER (PARTITION BY mean_prediction) - 1) / 2.0 AS r FROM b))
SELECT 'c_acctbal' AS feature, bin, n, round(rate, 9) AS rate, round(mean_prediction, 9) AS mean_prediction, CASE WHEN c > 0.3 THEN 'increasing' WHEN c < -0.3 THEN 'decreasing' ELSE 'mixed' END AS direction FROM b, k""")
def feature_effects(spark, d):
    """Label rate and mean score along a feature's quantile bins, and the direction."""
    x = scored(spark, d).join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return _rounded(R.feature_effects(x, "c_acctbal", "y", "score"), "rate", "mean_prediction")


_ORDER = "l_linenumber, ship, l_extendedprice, l_quantity, l_partkey"


@query(f"""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS t FROM orders), i AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000000 AS ship, l_extendedprice, l_quantity, l_partkey FROM lineitem), p("offset") AS (VALUES (0), (2), (4)),
en AS (SELECT o_orderkey, "offset", ship AS e_ship, l_extendedprice AS e_price FROM o CROSS JOIN p JOIN i ON l_orderkey = o_orderkey AND ship // {180 * DAY} = t // {180 * DAY} AND l_linenumber >= 1 + "offset"
 QUALIFY row_number() OVER (PARTITION BY o_orderkey, "offset" ORDER BY {_ORDER}) = 1),
ex AS (SELECT o_orderkey, "offset", l_extendedprice AS x_price FROM en JOIN i ON l_orderkey = o_orderkey AND ship >= e_ship + {6 * DAY}
 QUALIFY row_number() OVER (PARTITION BY o_orderkey, "offset" ORDER BY ship, {_ORDER}) = 1)
SELECT o_orderkey, "offset", e_price, x_price, round(coalesce(x_price / e_price - 1, -1), 9) AS roi, CASE WHEN x_price IS NULL THEN 1 ELSE 0 END AS forced FROM en LEFT JOIN ex USING (o_orderkey, "offset")""")
def intraslot_outcomes(spark, d):
    """Entries that must fall in the order's own slot, at or after an offset within it; without one there is no fill. Exits after a fixed hold."""
    slot = lambda c: F.floor(F.col(c) / (180 * DAY))
    left = orders(spark, d).select("o_orderkey", "t").crossJoin(F.broadcast(spark.sql("SELECT * FROM VALUES (0), (2), (4) AS p(offset)")))
    position = [F.col(c) for c in _ORDER.split(", ")]
    entry = M.first_match(left, items(spark, d), ["o_orderkey"], (slot("ship") == slot("t")) & (F.col("l_linenumber") >= 1 + F.col("offset")), position, ["ship", "l_extendedprice"], "e_", "inner")
    entry = entry.select("o_orderkey", "offset", "e_ship", F.col("e_l_extendedprice").alias("e_price"))
    both = M.first_match(entry, items(spark, d), ["o_orderkey"], F.col("ship") >= F.col("e_ship") + 6 * DAY, [F.col("ship"), *position], ["l_extendedprice"], "x_")
    price = F.col("x_l_extendedprice")
    return both.select("o_orderkey", "offset", "e_price", price.alias("x_price"), F.round(F.coalesce(price / F.col("e_price") - 1, F.lit(-1.0)), 9).alias("roi"), price.isNull().cast("int").alias("forced"))


@query("""WITH p AS (SELECT l_orderkey AS k, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS s FROM lineitem GROUP BY ALL), w AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS t FROM orders)
SELECT count(*) FILTER (WHERE w.k IS NULL) AS parts_only, count(*) FILTER (WHERE p.k IS NULL) AS whole_only, count(*) FILTER (WHERE p.k IS NOT NULL AND w.k IS NOT NULL AND abs(s - t) > 5000000) AS unequal FROM p FULL JOIN w ON p.k = w.k""")
def reconciliation(spark, d):
    """Orders whose items do not add up to their total, and keys that one table only holds."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), cents("l_extendedprice").alias("part"))
    return audit.reconcile(parts, read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("total")), ["k"], "part", "total", 5_000_000)


_FEATURES = ["o_totalprice", "c_acctbal"]


@query()
def ml_surrogate_rules(spark, d):
    """Lines of a shallow tree that imitates the boosted model, and the model's gains."""
    rows = _training(spark, d)
    model = learning.fit(rows, _FEATURES, "label", "gbt")
    lines = learning.surrogate(learning.predict(model, rows), _FEATURES, 0.5).splitlines()
    gains = [("gain", i, f"{n} {g:.6f}") for i, (n, g) in enumerate(learning.gain_importance(model, _FEATURES))]
    return spark.createDataFrame([*gains, *[("rule", i, x) for i, x in enumerate(lines)]], "kind string, line int, text string")


@query()
def ml_hard_negatives(spark, d):
    """A second model, for which the first one's false alarms weigh more."""
    rows = _training(spark, d)
    first = learning.fit(rows, _FEATURES, "label")
    second = learning.fit(learning.harder(rows, first, "label", 0.5, 3.0), _FEATURES, "label")
    return learning.predict(second, rows).select("id", "label", "score")


@query()
def ml_history_mixture(spark, d):
    """One model for customers with other orders, one for those without."""
    rows = _training(spark, d)
    many = rows.groupBy("o_custkey").count().where("count > 1").select("o_custkey", F.lit(False).alias("cold"))
    rows = rows.join(many, "o_custkey", "left").withColumn("cold", F.coalesce("cold", F.lit(True)))
    known = learning.fit(rows.where("not cold"), _FEATURES, "label")
    cold = learning.fit(rows, ["o_totalprice"], "label")
    return learning.by_history(rows, "cold", known, cold).select("id", "label", "cold", "score")


@query()
def ml_ablation(spark, d):
    """Average precision of feature sets in two windows of time, each fitted on what comes before."""
    rows = _training(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), "id")
    years = [r[0] for r in rows.select("year").distinct().orderBy("year").collect()]
    windows = {str(y): (rows.where(F.col("year") < y), rows.where(F.col("year") == y)) for y in years[1:][-2:]}
    run = lambda train, test, cols: E.average_precision(learning.predict(learning.fit(train, cols, "label"), test), "label", "score")
    return promotion.ablation({"price": ["o_totalprice"], "both": _FEATURES}, windows, run)
