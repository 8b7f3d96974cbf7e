"""Messages (orders with their items as instructions) and the identity marks that they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.expressions import seconds
from asofkit.operators import audit
from asofkit.operators import identity as I
from asofkit.plans.asof import DAY
from asofkit.plans.registry import query, read

_O = "epoch_us(o_orderdate) // 1000000"
#: Kind of mark -> SQL over the message m with its items xs (in order); the frames below say the same.
_KINDS = {
    "sequence": "array_to_string(list_transform(xs, lambda x: x.f), '>')",
    "members": "array_to_string(list_sort(list_distinct(list_transform(xs, lambda x: x.f || x.s))), '|')",
    "shape": "len(xs)::VARCHAR",
    "opening": "(xs[1].k % 100)::VARCHAR",
    "accounts": "array_to_string(list_sort(list_distinct(list_transform(xs, lambda x: x.u % 10))), '|')",
    "limit": "CASE WHEN list_max(list_transform(xs, lambda x: x.q)) >= 45 THEN 'high' WHEN list_max(list_transform(xs, lambda x: x.q)) >= 25 THEN 'mid' END",
    "payer": "c::VARCHAR",
}
_M = f"""i AS (SELECT l_orderkey, list({{n: l_linenumber, k: l_partkey, u: l_suppkey, q: l_quantity, f: l_returnflag, s: l_linestatus}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS xs FROM lineitem GROUP BY ALL),
m AS (SELECT o_orderkey, o_custkey AS c, {_O} AS t, (o_orderpriority = '1-URGENT')::INT AS y, xs FROM orders JOIN i ON l_orderkey = o_orderkey),
k AS ({" UNION ALL ".join(f"SELECT o_orderkey, c, t, y, '{n}' AS kind, {e} AS value FROM m" for n, e in _KINDS.items())}), marks AS (SELECT * FROM k WHERE value IS NOT NULL)"""
_H = f"""f AS (SELECT kind, value, t, count(*) AS fresh FROM (SELECT kind, value, c, min(t) AS t FROM marks GROUP BY ALL) GROUP BY ALL), g AS (SELECT kind, value, t, count(*) AS n, sum(y) AS y FROM marks GROUP BY ALL),
h AS (SELECT kind, value, t, coalesce(sum(n) OVER b, 0)::BIGINT AS prior, coalesce(sum(n) OVER (PARTITION BY kind, value ORDER BY t RANGE BETWEEN {90 * DAY} PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recent, coalesce(sum(y) OVER b, 0)::BIGINT AS successes,
 coalesce(sum(y) OVER b, 0) / (coalesce(sum(n) OVER b, 0) + 20.0) AS rate, t - lag(t) OVER (PARTITION BY kind, value ORDER BY t) AS age, coalesce(sum(fresh) OVER b, 0)::BIGINT AS senders FROM g LEFT JOIN f USING (kind, value, t) WINDOW b AS (PARTITION BY kind, value ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _messages(spark, d):
    member = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    items = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(member)).alias("xs"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), seconds(F.col("o_orderdate")).alias("t"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return o.join(items, "o_orderkey")


def _kinds():
    xs = F.col("xs")
    each = lambda f: F.transform(xs, f)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), "|")
    top = F.array_max(each(lambda x: x["l_quantity"]))
    return {
        "sequence": F.array_join(each(lambda x: x["l_returnflag"]), ">"),
        "members": joined(each(lambda x: F.concat(x["l_returnflag"], x["l_linestatus"]))),
        "shape": F.size(xs),
        "opening": F.get(xs, 0)["l_partkey"] % 100,
        "accounts": joined(each(lambda x: (x["l_suppkey"] % 10).cast("string"))),
        "limit": F.when(top >= 45, "high").when(top >= 25, "mid"),
        "payer": F.col("c"),
    }


def _marks(spark, d, cutoff=None):
    return I.marks(_messages(spark, d), ["o_orderkey", "c", "t", "y"], _kinds(), "t", cutoff)


@query(f"WITH {_M} SELECT o_orderkey, kind, value FROM marks")
def message_marks(spark, d):
    """The identity marks of every message."""
    return _marks(spark, d).select("o_orderkey", "kind", "value")


@query(f"WITH {_M} SELECT o_orderkey, kind, value, t FROM marks WHERE t < 820454400")
def message_marks_before(spark, d):
    """Marks of the messages before a cutoff."""
    return _marks(spark, d, 820454400).select("o_orderkey", "kind", "value", "t")


@query(f"WITH {_M}, {_H}, j AS (SELECT o_orderkey, kind, h.* EXCLUDE (kind, value, t) FROM marks JOIN h USING (kind, value, t)) SELECT o_orderkey, {', '.join(f'''{'round(' if m == 'rate' else ''}max({m}) FILTER (WHERE kind = '{k}'){', 9)' if m == 'rate' else ''} AS {k}_{m}''' for k in _KINDS for m in I.MEASURES)} FROM j GROUP BY ALL")
def message_history(spark, d):
    """42 columns: for each of seven kinds of marks, six measures of what was seen of it strictly before."""
    marked = _marks(spark, d)
    past = I.history(marked, "t", "c", "y", 90 * DAY, 20.0)
    got = I.features(marked, past, "o_orderkey", "t", list(_KINDS))
    return got.withColumns({f"{k}_rate": F.round(f"{k}_rate", 9) for k in _KINDS})


@query(f"WITH {_M}, {_H} SELECT kind, count(*) AS rows, count(*) FILTER (WHERE recent > prior) AS recent_over_prior, count(*) FILTER (WHERE successes > prior) AS successes_over_prior, count(*) FILTER (WHERE senders > prior) AS senders_over_prior, count(*) FILTER (WHERE age <= 0) AS age_not_positive, count(*) FILTER (WHERE (age IS NULL) <> (prior = 0)) AS age_without_prior, max(prior)::BIGINT AS most FROM h GROUP BY ALL")
def message_audit(spark, d):
    """Rules that the history of marks must keep, by kind."""
    past = I.history(_marks(spark, d), "t", "c", "y", 90 * DAY, 20.0)
    c = F.col
    bad = {"recent_over_prior": c("recent") > c("prior"), "successes_over_prior": c("successes") > c("prior"), "senders_over_prior": c("senders") > c("prior"), "age_not_positive": c("age") <= 0, "age_without_prior": c("age").isNull() != (c("prior") == 0)}
    return past.groupBy("kind").agg(F.count("*").alias("rows"), *[F.count_if(x).alias(n) for n, x in bad.items()], F.max("prior").alias("most"))


@query(f"WITH {_M}, {_H} SELECT (SELECT count(*) FROM marks) AS marks, (SELECT count(DISTINCT o_orderkey) FROM marks) AS messages, count(*) AS states, (sum(('0x' || substr(sha256(kind || '|' || value || '|' || t || '|' || prior), 1, 15))::BIGINT))::DECIMAL(38, 0) AS checksum FROM h")
def cache_contract(spark, d):
    """Counts and a checksum by which a cached history is held against a new one."""
    marked = _marks(spark, d)
    past = I.history(marked, "t", "c", "y", 90 * DAY, 20.0)
    one = marked.agg(F.count("*").alias("marks"), F.countDistinct("o_orderkey").alias("messages"))
    return one.crossJoin(audit.checksum(past, ["kind", "value", "t", "prior"]).withColumnRenamed("rows", "states"))
