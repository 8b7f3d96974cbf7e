"""Group aggregates, keyed augmentation, samples and picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import augment as G
from asofkit.operators import selection as S
from asofkit.plans.asof import events, hourly, orders
from asofkit.plans.registry import query, read

_E = "epoch_us(ts) // 1000000"
_O = "epoch_us(o_orderdate) // 1000000"


@query("SELECT o_custkey, any_value(o_custkey % 25) AS same, min(o_orderstatus) AS status FROM orders GROUP BY ALL")
def any_of_group(spark, d):
    """A value that is the same in the whole group; where it may differ the least is taken."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.any_value(F.col("o_custkey") % 25).alias("same"), F.min("o_orderstatus").alias("status"))


@query("SELECT user_id, len(list(value)) AS n, array_to_string(list_transform(list_sort(list(value), 'ASC', 'NULLS FIRST'), lambda x: coalesce((round(x * 100)::BIGINT)::VARCHAR, '~')), ',') AS vs FROM events GROUP BY ALL")
def list_with_nulls(spark, d):
    """All values of a group, nulls and repeats among them: each in a struct, as plain lists drop nulls."""
    cents = F.round(F.col("value") * 100).cast("long")
    g = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("value").alias("v"), cents.alias("c")))).alias("xs"))
    return g.select("user_id", F.size("xs").cast("long").alias("n"), F.array_join(F.transform("xs", lambda x: F.coalesce(x["c"].cast("string"), F.lit("~"))), ",").alias("vs"))


@query("SELECT user_id, min(nullif(trim(event_type), '')) AS kind, coalesce(arg_min(nullif(json_extract_string(props, '$.k'), ''), event_id) FILTER (WHERE nullif(json_extract_string(props, '$.k'), '') IS NOT NULL), '-') AS k FROM events GROUP BY ALL")
def first_non_empty(spark, d):
    """The first text of a group that isn't empty, in the order of the rows' ids."""
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit(""))
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.min(F.nullif(F.trim("event_type"), F.lit(""))).alias("kind"), F.coalesce(F.min_by(k, F.when(k.isNotNull(), F.col("event_id"))), F.lit("-")).alias("k"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC) AS place FROM orders")
def rank_min_descending(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc(F.round(F.col("o_totalprice") / 1000)))
    return read(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256('s1' || o_orderkey), o_orderkey LIMIT 250")
def exact_sample(spark, d):
    return S.exact_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 250, "s1")


@query("SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS y FROM orders WHERE o_orderpriority = '1-URGENT' OR ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 5 = 0")
def sample_negatives(spark, d):
    """All positives, and one negative in five by a hash of the key."""
    from asofkit.operators.ranking import hash_pick

    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return S.keep_positives(o, "y", hash_pick(F.col("o_orderkey"), 5))


@query("WITH s AS (SELECT o_orderkey AS id, round(o_totalprice / 5000)::BIGINT AS score, (o_orderpriority = '1-URGENT')::INT AS y FROM orders WHERE o_totalprice > 100000) SELECT id, score, y FROM s WHERE y = 0 ORDER BY score DESC, id LIMIT (SELECT (sum(y) * 2)::BIGINT FROM s)")
def hardest_negatives(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 100000")
    rows = o.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 5000).cast("long").alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return S.hardest(rows, "y", "score", "id", 2)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def sources_by_flag(spark, d):
    """Columns of the sources whose flags are set, joined row for row on unique keys."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    got = G.from_sources(c, ["c_nationkey"], {"nation": nation, "supplier": nation}, {"nation": True, "supplier": False})
    return G.augment(got, region, ["n_regionkey"], "region").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, p AS part FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, {l: l_linenumber, p: l_partkey}) AS p FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def look_up_last(spark, d):
    """A dictionary whose last entry of a key holds."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return G.look_up(read(spark, d, "orders").select("o_orderkey"), li, "o_orderkey", "part", "at")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, d):
    rich = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_mktsegment").join(rich, "c_custkey", "left_semi")


@query(f"""WITH h AS (SELECT user_id, ({_E}) // 3600 * 3600 AS t, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, ({_E}) // 3600 * 3600 AS t, count(*) AS buys FROM events WHERE event_type = 'purchase' GROUP BY ALL),
s AS (SELECT user_id, t, (sum(buys) OVER (PARTITION BY user_id ORDER BY t))::BIGINT AS total FROM b)
SELECT h.user_id, h.t, h.n, s.total AS b_total, h.t - s.t AS b_age FROM h ASOF LEFT JOIN s ON h.user_id = s.user_id AND h.t > s.t""")
def state_onto_state(spark, d):
    """Each hourly state of a user with the latest state of purchases strictly before it."""
    from asofkit.operators import history as H

    buys = events(spark, d).where("event_type = 'purchase'").withColumn("t", F.floor(F.col("t") / 3600) * 3600)
    s = H.cumulative(H.per_time(buys, ["user_id"], "t", {"buys": F.count("*")}), ["user_id"], "t", {"total": F.sum("buys")}).select("user_id", "t", "total")
    return G.state_onto_state(hourly(spark, d).select("user_id", "t", "n"), s, ["user_id"], "t", ["total"], "b_")


@query(f"""WITH s AS (SELECT user_id, min({_E}) AS start FROM events WHERE event_type = 'signup' GROUP BY ALL), b AS (SELECT user_id, count(*) AS buys, min({_E}) AS f FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, buys, start IS NULL OR f < start AS censored FROM b LEFT JOIN s USING (user_id)""")
def left_censored(spark, d):
    """Outcomes whose start was never seen, or was seen after them."""
    e = events(spark, d)
    s = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("start"))
    b = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("buys"), F.min("t").alias("f"))
    return b.join(s, "user_id", "left").select("user_id", "buys", (F.col("start").isNull() | (F.col("f") < F.col("start"))).alias("censored"))


@query(f"""SELECT o_orderkey, {_O} AS t, o_totalprice FROM orders WHERE {_O} >= 725846400 AND {_O} < 788918400""")
def chronological_split(spark, d):
    """A window of time with the features of the groups in use that the table has."""
    rows = orders(spark, d)
    return S.split(rows, "t", 725846400, 788918400, ["o_orderkey", "t"], {"price": ["o_totalprice", "o_tax"], "customer": ["o_custkey"]}, ["price"])


@query("WITH p AS (SELECT table_name AS t, column_name AS c FROM (VALUES ('x', 'a')) AS v(table_name, column_name)) SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def in_memory_relation(spark, d):
    """A small frame of the driver that takes part as a relation."""
    keep = spark.createDataFrame([("c_acctbal", 2)], "name string, places int")
    return read(spark, d, "customer").join(F.broadcast(keep), F.lit(True)).select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(DISTINCT epoch_us(ts) // 1000000) AS seconds, max(k)::BIGINT AS busiest FROM (SELECT ts, count(*) OVER (PARTITION BY epoch_us(ts) // 1000000) AS k FROM events) GROUP BY ALL")
def second_frequency(spark, d):
    """How many events share a second, summed up by minute: counts by second first, so that no window holds them."""
    by = read(spark, d, "events").groupBy(seconds(F.col("ts")).alias("s"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count("*").alias("k"))
    return by.groupBy("minute").agg(F.sum("k").alias("n"), F.count("*").alias("seconds"), F.max("k").alias("busiest"))
