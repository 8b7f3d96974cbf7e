"""The feature store in full: histories of several keys strictly before each decision, and a state probed at several lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import ratio
from asofkit.operators import asof as A
from asofkit.operators import audit
from asofkit.operators import history as H
from asofkit.plans.asof import DAY, events, orders
from asofkit.plans.registry import query, read

_O = "epoch_us(o_orderdate) // 1000000"
_E = "epoch_us(ts) // 1000000"
#: Name of a history -> its keys; each has the counts, sums and times of earlier orders of the same keys.
_KEYS = {
    "customer": ["o_custkey"],
    "nation": ["c_nationkey"],
    "segment": ["c_mktsegment"],
    "priority": ["c_nationkey", "o_orderpriority"],
    "pair": ["o_custkey", "o_orderpriority"],
}
_HORIZONS = {"30d": 30 * DAY, "365d": 365 * DAY}


def _with_history(rows, name, keys):
    """rows with prior, prior cents, rolling counts and recency of their keys; peers of the same second never see each other."""
    g = H.strict_prior(H.per_time(rows, keys, "t", {"n": F.count("*"), "c": F.sum("cents")}), keys, "t", {f"{name}_prior": "n", f"{name}_cents": "c"})
    g = H.rolling(g, keys, "t", "n", {f"{name}_{h}": s for h, s in _HORIZONS.items()})
    g = H.recency(g, keys, "t", f"{name}_age").drop("n", "c")
    return rows.join(g, [*keys, "t"])


def _history_sql(name, keys):
    k = ", ".join(keys)
    rolled = ", ".join(f"coalesce(sum(n) OVER (PARTITION BY {k} ORDER BY t RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING), 0)::BIGINT AS {name}_{h}" for h, s in _HORIZONS.items())
    return f"""{name} AS (SELECT {k}, t, coalesce(sum(n) OVER w, 0)::BIGINT AS {name}_prior, coalesce(sum(c) OVER w, 0)::BIGINT AS {name}_cents, {rolled}, t - lag(t) OVER (PARTITION BY {k} ORDER BY t) AS {name}_age
 FROM (SELECT {k}, t, count(*) AS n, sum(cents) AS c FROM d GROUP BY ALL) WINDOW w AS (PARTITION BY {k} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_COLUMNS = [f"{n}_{m}" for n in _KEYS for m in ("prior", "cents", *_HORIZONS, "age")]
_D = f"d AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_nationkey, c_mktsegment, {_O} AS t, round(o_totalprice * 100)::BIGINT AS cents FROM orders JOIN customer ON c_custkey = o_custkey)"
_BASE = f"{_D}, {', '.join(_history_sql(n, k) for n, k in _KEYS.items())}, base AS (SELECT o_orderkey, d.t, {', '.join(_COLUMNS)} FROM d {' '.join(f'JOIN {n} USING ({', '.join([*k, 't'])})' for n, k in _KEYS.items())})"


def _base(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    more = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = orders(spark, d).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")).join(more, "o_orderkey").join(c, "o_custkey")
    for name, keys in _KEYS.items():
        rows = _with_history(rows, name, keys)
    return rows.select("o_orderkey", "t", *_COLUMNS)


@query(f"WITH {_BASE} SELECT * FROM base")
def base_features(spark, d):
    """Five histories of each order, each with count, sum, two rolling windows and recency, all strictly before it."""
    return _base(spark, d)


@query(f"WITH {_BASE} SELECT count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {n}_30d > {n}_365d OR {n}_365d > {n}_prior) AS {n}_windows, count(*) FILTER (WHERE ({n}_age IS NULL) <> ({n}_prior = 0) OR {n}_age <= 0) AS {n}_age' for n in _KEYS)}, count(*) FILTER (WHERE pair_prior > customer_prior OR customer_prior > nation_prior) AS nesting FROM base")
def base_features_audit(spark, d):
    """Nested windows, recency and nested keys of the base features: how many rows break each rule."""
    c, rules = F.col, {}
    for n in _KEYS:
        rules[f"{n}_windows"] = (c(f"{n}_30d") <= c(f"{n}_365d")) & (c(f"{n}_365d") <= c(f"{n}_prior"))
        rules[f"{n}_age"] = (c(f"{n}_age").isNull() == (c(f"{n}_prior") == 0)) & F.coalesce(c(f"{n}_age") > 0, F.lit(True))
    rules["nesting"] = (c("pair_prior") <= c("customer_prior")) & (c("customer_prior") <= c("nation_prior"))
    return audit.counts(_base(spark, d), rules)


_LAGS = {"now": 0, "1h": 3600, "1d": DAY, "7d": 7 * DAY}
_KINDS = ("view", "click", "purchase")
_STATE = f"""g AS (SELECT user_id, {_E} AS t, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)}, sum(round(coalesce(value, 0) * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL),
state AS (SELECT user_id, t, {', '.join(f"(sum({k}) OVER w)::BIGINT AS {k}" for k in (*_KINDS, 'cents'))}, max(kinds) OVER w AS kinds, max(CASE WHEN purchase > 0 THEN t END) OVER w AS last_buy FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def _activity(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    e = events(spark, d)
    g = H.per_time(e, ["user_id"], "t", {**{k: kind(k) for k in _KINDS}, "cents": F.sum(F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")), "kinds": F.countDistinct("event_type")})
    return H.cumulative(g, ["user_id"], "t", {**{k: F.sum(k) for k in (*_KINDS, "cents")}, "kinds": F.max("kinds"), "last_buy": F.max(F.when(F.col("purchase") > 0, F.col("t")))})


@query(f"WITH {_STATE} SELECT user_id, t, view, click, purchase, cents, kinds, last_buy FROM state")
def activity_state(spark, d):
    """A user's cumulative counts by kind, sums, extremes and last purchase, a row a second."""
    return _activity(spark, d).select("user_id", "t", *_KINDS, "cents", "kinds", "last_buy")


@query(f"""WITH {_STATE} SELECT e.event_id, hour(e.ts) AS hour, dayofweek(e.ts) AS weekday, {', '.join(f"coalesce(s_now.{k}, 0) AS {k}" for k in _KINDS)}, {', '.join(f"coalesce(s_now.{k}, 0) - coalesce(s_{n}.{k}, 0) AS {k}_{n}" for n in list(_LAGS)[1:] for k in _KINDS)},
 round(coalesce(s_now.cents, 0) / greatest(coalesce(s_now.purchase, 0), 1), 9) AS mean_cents, {_E.replace('ts', 'e.ts')} - s_now.t AS since_any, {_E.replace('ts', 'e.ts')} - s_now.last_buy AS since_buy, (s_now.t IS NULL)::INT AS missing
FROM events e {' '.join(f"ASOF LEFT JOIN state s_{n} ON e.user_id = s_{n}.user_id AND {_E.replace('ts', 'e.ts')} - {lag} > s_{n}.t" for n, lag in _LAGS.items())} WHERE e.event_type = 'click'""")
def feature_store(spark, d):
    """Each decision with the state strictly before it at four lags: totals, rolling windows as differences, recency, what is missing."""
    e = read(spark, d, "events").where("event_type = 'click'")
    probes = e.join(events(spark, d).select("event_id", F.col("t").alias("at")), "event_id").select("event_id", "user_id", "at", F.hour("ts").cast("long").alias("hour"), (F.dayofweek("ts") - 1).cast("long").alias("weekday"))
    got = A.asof_horizons(probes, _activity(spark, d), ["user_id"], "at", "t", [*_KINDS, "cents", "last_buy"], {f"{n}__": lag for n, lag in _LAGS.items()})
    z = lambda n, k: F.coalesce(F.col(f"{n}__{k}"), F.lit(0))
    rolled = [(z("now", k) - z(n, k)).alias(f"{k}_{n}") for n in list(_LAGS)[1:] for k in _KINDS]
    last = [(F.col("at") - F.col(f"now__{c}")).alias(a) for c, a in (("t", "since_any"), ("last_buy", "since_buy"))]
    return got.select("event_id", "hour", "weekday", *[z("now", k).alias(k) for k in _KINDS], *rolled, F.round(ratio(z("now", "cents"), z("now", "purchase")), 9).alias("mean_cents"), *last, F.col("now__t").isNull().cast("int").alias("missing"))
