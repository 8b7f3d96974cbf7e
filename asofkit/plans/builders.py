"""Composite builders: sales of what an entity started, relationships, strategy parameters, cohorts, replays; and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import ratio, seconds
from asofkit.operators import asof as A
from asofkit.operators import audit
from asofkit.operators import history as H
from asofkit.operators import lifecycle as L
from asofkit.operators import matching as M
from asofkit.plans.asof import DAY, events, orders
from asofkit.plans.lifecycles import items, outcomes
from asofkit.plans.registry import ORACLE, query, read

HORIZON = 60 * DAY
_O = "epoch_us(o_orderdate) // 1000000"
_S = "epoch_us(l_shipdate) // 1000000"

# a start is an order, its entity the customer; its outcome is the first returned item shipped after it
_LIFE = f"""life AS (SELECT o_orderkey, o_custkey, {_O} AS start, min(CASE WHEN {_S} > {_O} THEN {_S} END) AS sold, count(CASE WHEN {_S} > {_O} THEN 1 END) AS sales FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey GROUP BY ALL)"""
_UPD = f"""u AS (SELECT o_custkey, start AS t, 1 AS started, 0 AS matured, 0 AS succeeded, 0 AS seen, 0 AS delay FROM life UNION ALL SELECT o_custkey, start + {HORIZON}, 0, 1, CASE WHEN sold <= start + {HORIZON} THEN 1 ELSE 0 END, 0, 0 FROM life UNION ALL SELECT o_custkey, sold, 0, 0, 0, 1, sold - start FROM life WHERE sold IS NOT NULL),
g AS (SELECT o_custkey, t, sum(started) AS started, sum(matured) AS matured, sum(succeeded) AS succeeded, sum(seen) AS seen, sum(delay) AS delay FROM u GROUP BY ALL),
state AS (SELECT o_custkey, t, (sum(started) OVER w)::BIGINT AS started, (sum(matured) OVER w)::BIGINT AS matured, (sum(succeeded) OVER w)::BIGINT AS succeeded, (sum(seen) OVER w)::BIGINT AS seen, (sum(delay) OVER w)::BIGINT AS delay FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY t))"""
_STATE = ("started", "matured", "succeeded", "seen", "delay")


def _sales(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_custkey", F.col("t").alias("start"))
    sold = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), seconds(F.col("l_shipdate")).alias("ship"))
    late = F.when(F.col("ship") > F.col("start"), F.col("ship"))
    return o.join(sold, "o_orderkey", "left").groupBy("o_orderkey", "o_custkey", "start").agg(F.min(late).alias("sold"), F.count(late).alias("sales"))


def _sale_state(spark, d):
    life = _sales(spark, d)
    zero = F.lit(0).cast("long")
    base = L.maturity_updates(life, "o_custkey", "start", "sold", HORIZON).withColumns({"seen": zero, "delay": zero})
    seen = life.where("sold is not null").select("o_custkey", F.col("sold").alias("t"), zero.alias("started"), zero.alias("matured"), zero.alias("succeeded"), F.lit(1).cast("long").alias("seen"), (F.col("sold") - F.col("start")).alias("delay"))
    merged = H.per_time(base.unionByName(seen), ["o_custkey"], "t", {c: F.sum(c) for c in _STATE})
    return H.cumulative(merged, ["o_custkey"], "t", {c: F.sum(c) for c in _STATE})


@query(f"WITH {_LIFE} SELECT o_orderkey, o_custkey, start, sold, sales FROM life")
def sale_lifecycle(spark, d):
    """Each start with the first sale after it, and how many."""
    return _sales(spark, d)


@query(f"WITH {_LIFE}, {_UPD} SELECT o_custkey, t, started, matured, succeeded, seen, delay FROM state")
def sale_state(spark, d):
    """A customer's starts, verdicts at the horizon, sales as they are seen, and the delays of those."""
    return _sale_state(spark, d).select("o_custkey", "t", *_STATE)


@query(f"""WITH {_LIFE}, {_UPD} SELECT l.o_orderkey, coalesce(a.started, 0) AS started, coalesce(a.matured, 0) AS matured, round(coalesce(a.succeeded, 0) / greatest(coalesce(a.matured, 0), 1), 9) AS rate, coalesce(a.seen, 0) - coalesce(b.seen, 0) AS seen_30d, coalesce(a.started, 0) - coalesce(c.started, 0) AS started_365d,
 round(coalesce(a.delay, 0) / greatest(coalesce(a.seen, 0), 1), 9) AS mean_delay, coalesce(a.started, 0) - coalesce(a.matured, 0) AS pending FROM life l ASOF LEFT JOIN state a ON l.o_custkey = a.o_custkey AND l.start > a.t ASOF LEFT JOIN state b ON l.o_custkey = b.o_custkey AND l.start - {30 * DAY} > b.t ASOF LEFT JOIN state c ON l.o_custkey = c.o_custkey AND l.start - {365 * DAY} > c.t""")
def sale_features(spark, d):
    """What was known of a customer's earlier starts at each start, over all time and rolling windows, from one as-of pass."""
    probes = orders(spark, d).select("o_orderkey", "o_custkey", F.col("t").alias("at"))
    got = A.asof_horizons(probes, _sale_state(spark, d), ["o_custkey"], "at", "t", list(_STATE), {"a_": 0, "b_": 30 * DAY, "c_": 365 * DAY})
    z = lambda c: F.coalesce(c, F.lit(0))
    return got.select(
        "o_orderkey", z("a_started").alias("started"), z("a_matured").alias("matured"), F.round(ratio(z("a_succeeded"), z("a_matured")), 9).alias("rate"), (z("a_seen") - z("b_seen")).alias("seen_30d"),
        (z("a_started") - z("c_started")).alias("started_365d"), F.round(ratio(z("a_delay"), z("a_seen")), 9).alias("mean_delay"), (z("a_started") - z("a_matured")).alias("pending"),
    )


@query(f"""WITH {_LIFE}, g AS (SELECT o_custkey, start AS gt, count(*) AS size, list(sold - start ORDER BY sold) FILTER (WHERE sold IS NOT NULL) AS ds FROM life GROUP BY ALL),
j AS (SELECT l.o_orderkey, l.start AS now, g.gt, g.size, list_filter(coalesce(g.ds, []), lambda x: x <= {HORIZON} AND g.gt + x < l.start) AS seen FROM life l ASOF LEFT JOIN g ON l.o_custkey = g.o_custkey AND l.start > g.gt)
SELECT o_orderkey, gt AS group_t, coalesce(size, 0) AS group_size, round(CASE WHEN size > 0 THEN len(seen) / size END, 9) AS observed, round(CASE WHEN size > 0 THEN CASE WHEN gt + {HORIZON} < now THEN (size - len(seen)) / size ELSE 0 END END, 9) AS matured_without,
 round(CASE WHEN size > 0 THEN CASE WHEN gt + {HORIZON} < now THEN 0 ELSE (size - len(seen)) / size END END, 9) AS pending, CASE WHEN len(seen) > 0 THEN (list_sort(seen)[(len(seen) + 1) // 2] + list_sort(seen)[len(seen) // 2 + 1]) / 2 END AS median_delay FROM j""")
def latest_tied_group(spark, d):
    """The latest earlier group of starts of one customer and second, its fates as of now: fractions that no order of members can change."""
    life = _sales(spark, d)
    g = life.groupBy("o_custkey", F.col("start").alias("gt")).agg(F.count("*").alias("size"), F.collect_list(F.col("sold") - F.col("start")).alias("ds"))
    got = A.asof_join(life.select("o_orderkey", "o_custkey", F.col("start").alias("now")), g, ["o_custkey"], "now", "gt", ["size", "ds"])
    seen = F.filter(F.coalesce("ds", F.array().cast("array<bigint>")), lambda x: (x <= HORIZON) & (F.col("gt") + x < F.col("now")))
    got = got.withColumn("seen", F.array_sort(seen)).withColumn("k", F.size("seen"))
    share, rest = lambda x: F.when(F.col("size") > 0, x), (F.col("size") - F.col("k")) / F.col("size")
    done = F.col("gt") + HORIZON < F.col("now")
    mid = lambda i: F.get("seen", F.floor(i).cast("int"))
    return got.select(
        "o_orderkey", F.col("gt").alias("group_t"), F.coalesce("size", F.lit(0)).alias("group_size"), F.round(share(F.col("k") / F.col("size")), 9).alias("observed"), F.round(share(F.when(done, rest).otherwise(0.0)), 9).alias("matured_without"),
        F.round(share(F.when(done, 0.0).otherwise(rest)), 9).alias("pending"), F.when(F.col("k") > 0, (mid((F.col("k") - 1) / 2) + mid(F.col("k") / 2)) / 2).alias("median_delay"),
    )


@query(f"WITH {_LIFE} SELECT count(*) AS rows, count(*) FILTER (WHERE sold <= start) AS not_after, count(*) FILTER (WHERE (sales > 0) <> (sold IS NOT NULL)) AS count_mismatch, count(*) FILTER (WHERE sold NOT BETWEEN start AND start + 1000 * {DAY}) AS out_of_range FROM life")
def sale_audit(spark, d):
    return audit.counts(_sales(spark, d), {"not_after": F.col("sold") > F.col("start"), "count_mismatch": (F.col("sales") > 0) == F.col("sold").isNotNull(), "out_of_range": F.col("sold").between(F.col("start"), F.col("start") + 1000 * DAY)})


@query(f"WITH {_LIFE}, g AS (SELECT o_custkey, start, count(*) AS n, count(sold) AS k FROM life GROUP BY ALL) SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS tied_groups, sum(n) FILTER (WHERE n > 1)::BIGINT AS tied_rows, max(n) AS largest, count(*) FILTER (WHERE n > 1 AND k = n) AS all_sold, count(*) FILTER (WHERE n > 1 AND k = 0) AS none_sold FROM g")
def tie_contract(spark, d):
    """Counts of starts that share a customer and a second; audit.require holds such counts to pinned values."""
    g = _sales(spark, d).groupBy("o_custkey", "start").agg(F.count("*").alias("n"), F.count("sold").alias("k"))
    tied = F.col("n") > 1
    return g.agg(F.count("*").alias("groups"), F.count_if(tied).alias("tied_groups"), F.sum(F.when(tied, F.col("n"))).alias("tied_rows"), F.max("n").alias("largest"), F.count_if(tied & (F.col("k") == F.col("n"))).alias("all_sold"), F.count_if(tied & (F.col("k") == 0)).alias("none_sold"))


@query(f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS t, round(coalesce(value, 0) * 100)::BIGINT AS c FROM events), s AS (SELECT user_id, min(t) AS start FROM e WHERE event_type = 'signup' GROUP BY ALL), b AS (SELECT user_id, t, sum(c)::BIGINT AS cents FROM e WHERE event_type = 'purchase' AND c > 0 GROUP BY ALL)
SELECT user_id, arg_min(cents, t) AS cents, min(t) AS first_t, min(t) - any_value(start) AS after FROM b JOIN s USING (user_id) GROUP BY ALL""")
def relationship_events(spark, d):
    """The first purchase of more than nothing of each user who signed up, the events of one second being one."""
    e = events(spark, d).withColumn("c", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long"))
    s = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("start"))
    b = H.per_time(e.where("event_type = 'purchase' and c > 0"), ["user_id"], "t", {"cents": F.sum("c")})
    first = b.groupBy("user_id").agg(F.min_by("cents", "t").alias("cents"), F.min("t").alias("first_t"))
    return first.join(s, "user_id").select("user_id", "cents", "first_t", (F.col("first_t") - F.col("start")).alias("after"))


@query(f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), s AS (SELECT user_id, min(t) AS start FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT event_type, count(*) FILTER (WHERE t < start) AS before, count(*) FILTER (WHERE t = start) AS at, count(*) FILTER (WHERE t > start) AS after, count(*) FILTER (WHERE start IS NULL) AS without FROM e LEFT JOIN s USING (user_id) GROUP BY ALL""")
def events_around_start(spark, d):
    """Events before, at and after their user's start."""
    e = events(spark, d)
    s = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("start"))
    t, start = F.col("t"), F.col("start")
    return e.join(s, "user_id", "left").groupBy("event_type").agg(F.count_if(t < start).alias("before"), F.count_if(t == start).alias("at"), F.count_if(t > start).alias("after"), F.count_if(start.isNull()).alias("without"))


_POS = f"""b AS (SELECT l_partkey, arg_min(round(l_extendedprice * 100)::BIGINT, {{t: {_S}, o: l_orderkey, l: l_linenumber, p: l_extendedprice, q: l_quantity, s: l_suppkey}}) AS stake, min({_S}) AS t0 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), r AS (SELECT l_partkey, min({_S}) AS t1 FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"""


@query(f"WITH {_POS} SELECT count(*) AS positions, median(stake) AS stake, median(t1 - t0) FILTER (WHERE t1 > t0) AS hold, count(*) FILTER (WHERE t1 > t0) AS closed, round(sum(stake * 0.0125), 2) AS cost FROM b LEFT JOIN r USING (l_partkey) WHERE t0 < 820454400")
def strategy_parameters(spark, d):
    """Median stake of first buys, median hold of those closed, and cost, of positions opened before the period."""
    li = read(spark, d, "lineitem").withColumns({"t": seconds(F.col("l_shipdate")), "c": F.round(F.col("l_extendedprice") * 100).cast("long")})
    first = F.struct("t", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey")
    b = li.where("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.min_by("c", first).alias("stake"), F.min("t").alias("t0"))
    r = li.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("t").alias("t1"))
    later = F.col("t1") > F.col("t0")
    return b.where("t0 < 820454400").join(r, "l_partkey", "left").agg(F.count("*").alias("positions"), F.median("stake").alias("stake"), F.median(F.when(later, F.col("t1") - F.col("t0"))).alias("hold"), F.count_if(later).alias("closed"), F.round(F.sum(F.col("stake") * 0.0125), 2).alias("cost"))


_OUT = "x AS (" + ORACLE["delay_policy_outcomes"] + ")"


@query(f"""WITH {_OUT}, s AS (SELECT o_orderkey, o_totalprice > 200000 AS a, o_orderpriority IN ('1-URGENT', '2-HIGH') AS b FROM orders), c AS (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'neither' END AS cohort, roi, forced FROM s JOIN x USING (o_orderkey) WHERE delay = 0)
SELECT cohort, count(*) AS n, round(avg(1 - forced), 9) AS fill_rate, round(median(roi), 9) AS median_roi, round(avg((roi > 0)::INT), 9) AS hit_rate FROM c GROUP BY ALL""")
def disagreement_cohorts(spark, d):
    """Outcomes of what both of two selections take, either alone, or neither."""
    a, b = F.col("o_totalprice") > 200000, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    s = read(spark, d, "orders").select("o_orderkey", F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither").alias("cohort"))
    x = outcomes(spark, d).where("delay = 0").join(s, "o_orderkey")
    return x.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("forced")), 9).alias("fill_rate"), F.round(F.median("roi"), 9).alias("median_roi"), F.round(F.avg((F.col("roi") > 0).cast("int")), 9).alias("hit_rate"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag = 'R' AS got, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem), g AS (SELECT l_orderkey, sum(CASE WHEN got THEN c ELSE -c END)::BIGINT AS flow, max(got::INT) AS closed FROM c GROUP BY ALL)
SELECT o_orderpriority, count(*) AS positions, count(flow) AS with_flow, sum(flow)::BIGINT AS total, count(*) FILTER (WHERE flow > 0) AS gains, sum(coalesce(closed, 0))::BIGINT AS closed FROM orders LEFT JOIN g ON l_orderkey = o_orderkey GROUP BY ALL""")
def cash_flow_summary(spark, d):
    """What was in fact paid and got, over positions with and without any flow."""
    got = F.col("l_returnflag") == "R"
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(got, c).otherwise(-c)).alias("flow"), F.max(got.cast("int")).alias("closed"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(g, "o_orderkey", "left")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("positions"), F.count("flow").alias("with_flow"), F.sum("flow").alias("total"), F.count_if(F.col("flow") > 0).alias("gains"), F.sum(F.coalesce("closed", F.lit(0))).alias("closed"))


@query(f"""WITH i AS (SELECT l_orderkey, {_S} AS ship, l_linenumber AS n, l_partkey AS k, l_extendedprice AS p, l_quantity AS q FROM lineitem), en AS (SELECT o_orderkey, {_O} AS t, min({{s: ship, n: n, p: p, q: q, k: k}}) AS e FROM orders JOIN i ON l_orderkey = o_orderkey WHERE ship > {_O} GROUP BY ALL)
SELECT o_orderkey, any_value(e.s) AS entry_t, any_value(e.n) AS entry_n, min({{s: ship, n: n}}).s AS exit_t, min({{s: ship, n: n}}).n AS exit_n FROM en JOIN i ON l_orderkey = o_orderkey AND ship >= e.s + {10 * DAY} GROUP BY ALL""")
def replay_anchors(spark, d):
    """Entry and exit trades to replay from; what has no exit is left out."""
    order = [F.col(c) for c in ("ship", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")]
    e = M.first_match(orders(spark, d).select("o_orderkey", "t"), items(spark, d), ["o_orderkey"], F.col("ship") > F.col("t"), order, ["ship", "l_linenumber"], "e_", "inner")
    x = M.first_match(e, items(spark, d), ["o_orderkey"], F.col("ship") >= F.col("e_ship") + 10 * DAY, order[:2], ["ship", "l_linenumber"], "x_", "inner")
    return x.select("o_orderkey", F.col("e_ship").alias("entry_t"), F.col("e_l_linenumber").alias("entry_n"), F.col("x_ship").alias("exit_t"), F.col("x_l_linenumber").alias("exit_n"))


@query("""WITH s AS (SELECT l_partkey, epoch_us(l_shipdate) // 1000000 // 86400 AS day, l_orderkey, l_linenumber FROM lineitem), c AS (SELECT l_partkey, count(*) AS n, count(DISTINCT day) AS days FROM s GROUP BY ALL), b AS (SELECT day, count(*) AS rows FROM s GROUP BY ALL)
SELECT p_brand, count(*) AS parts, count(c.l_partkey) AS available, sum(c.days)::BIGINT AS day_reads, sum(c.n)::BIGINT AS rows, (SELECT max(rows) FROM b) AS largest_day FROM part LEFT JOIN c ON l_partkey = p_partkey GROUP BY ALL""")
def availability_audit(spark, d):
    """What each cohort has available, and how many batches would have to be read for it."""
    s = read(spark, d, "lineitem").select("l_partkey", F.floor(seconds(F.col("l_shipdate")) / DAY).alias("day"))
    c = s.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))
    top = s.groupBy("day").count().agg(F.max("count").alias("largest_day"))
    g = read(spark, d, "part").select("p_partkey", "p_brand").join(c, "p_partkey", "left").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count("n").alias("available"), F.sum("days").alias("day_reads"), F.sum("n").alias("rows"))
    return g.crossJoin(F.broadcast(top))


@query()
def curve_replay(spark, d):
    """Own positions put into each part's market of whole trades, under both intents and two fee rates; status and figures."""
    from asofkit.operators import replay as R

    # fixed values: the reserves a market starts with, and units a coin
    start = R.Market(30_000_000_000, 1_073_000_000_000_000, 0, 793_100_000_000_000)
    t = read(spark, d, "lineitem").select(F.col("l_partkey").alias("token"), seconds(F.col("l_shipdate")).alias("slot"), F.col("l_linenumber").cast("long").alias("tx"), F.col("l_orderkey").alias("event"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.lit("pump").alias("program"), (F.col("l_quantity") * 1000).alias("tokens"), F.lit(0.0).alias("quote"), F.lit(0.0).alias("price"))
    # a market's first trade is a buy at the expected price
    first = t.groupBy("token").agg(F.min(F.struct("slot", "tx", "event")).alias("f"), F.max(F.struct("slot", "tx", "event")).alias("l"))
    t = t.join(first.select("token", "f"), "token")
    is_first = F.struct("slot", "tx", "event") == F.col("f")
    after = (F.lit(float(start.virtual_quote * start.virtual_token)) / (F.lit(float(start.virtual_token)) - F.col("tokens") * 1e6)) / (F.lit(float(start.virtual_token)) - F.col("tokens") * 1e6) * 1e6 / 1e9
    t = t.withColumns({"side": F.when(is_first, "buy").otherwise(F.col("side")), "price": F.when(is_first, after).otherwise(0.0)}).drop("f")
    a = first.select("token", F.lit("delay_0").alias("policy"), F.lit("pump").alias("entry_program"), F.lit("pump").alias("exit_program"), *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for n, s in (("entry", "f"), ("exit", "l")) for c in ("slot", "tx", "event")])
    return R.replay_positions(t, a, R.Rules(start), [0.0095, 0.0125])


@query()
def curve_coverage(spark, d):
    from asofkit.operators.replay import coverage

    return coverage(curve_replay(spark, d), ["policy", "intent", "rate"])
