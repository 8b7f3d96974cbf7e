"""Text, url and JSON expressions, fingerprints, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import expressions as X
from asofkit.plans.asof import events
from asofkit.plans.registry import query, read


@query(r"""SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
 length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS non_ascii, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1), 9) AS upper_fraction,
 (contains(text, 'http://') OR contains(text, 'https://') OR contains(text, '.com') OR contains(text, '$')) AS has_link FROM documents""")
def text_features(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), X.word_count(t).cast("long").alias("words"), X.digits(t).cast("long").alias("digits"), X.non_ascii(t).cast("long").alias("non_ascii"), F.round(X.upper_fraction(t), 9).alias("upper_fraction"), X.contains_any(t, ["http://", "https://", ".com", "$"]).alias("has_link"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 'none' WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'org' WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 'net' ELSE 'other' END AS provider FROM h""")
def url_provider(spark, d):
    h = F.col("host")
    ends = lambda s: (h == s) | F.endswith(h, F.lit("." + s))
    return read(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("host")).withColumn("provider", F.when(h == "", "none").when(ends("example.org"), "org").when(ends("example.net"), "net").otherwise("other"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("SELECT user_id, round(sum(exp(-(1704067200 + 31536000 - epoch_us(ts) // 1000000) * (0.6931471805599453 / 2592000.0))), 6) AS weight, round(count(*) FILTER (WHERE event_type = 'purchase') / (count(*) + 20.0), 9) AS shrunk FROM events GROUP BY ALL")
def decay_weight(spark, d):
    """Events weighted by age with a half-life of 30 days, anchored at a fixed moment; a rate drawn to 0."""
    age = F.lit(1704067200 + 31536000) - F.col("t")
    return events(spark, d).groupBy("user_id").agg(F.round(F.sum(X.decay(age, 2592000.0)), 6).alias("weight"), F.round(X.shrunk_rate(F.count_if(F.col("event_type") == "purchase"), F.count("*"), 20.0), 9).alias("shrunk"))


_FINGER = """f AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, unnest(['type', 'hour', 'weekday']) AS kind, unnest([event_type, hour(ts)::VARCHAR, dayofweek(ts)::VARCHAR]) AS v FROM events)"""


@query(f"WITH {_FINGER} SELECT * FROM f")
def fingerprint_explode(spark, d):
    """Identity marks of each event, a row each."""
    marks = F.array(F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("v")), F.struct(F.lit("hour").alias("kind"), F.hour("ts").cast("string").alias("v")), F.struct(F.lit("weekday").alias("kind"), (F.dayofweek("ts") - 1).cast("string").alias("v")))
    return read(spark, d, "events").select("event_id", "user_id", X.seconds(F.col("ts")).alias("t"), F.explode(marks).alias("m")).select("event_id", "user_id", "t", "m.kind", "m.v")


@query(f"""WITH {_FINGER}, g AS (SELECT kind, v, user_id, t, count(*) AS n FROM f GROUP BY ALL), p AS (SELECT kind, v, user_id, t, coalesce(sum(n) OVER (PARTITION BY user_id, kind, v ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM g),
j AS (SELECT f.event_id, f.kind, p.prior FROM f JOIN p USING (kind, v, user_id, t)) SELECT event_id, coalesce(max(prior) FILTER (WHERE kind = 'hour'), 0) AS hour, coalesce(max(prior) FILTER (WHERE kind = 'type'), 0) AS type, coalesce(max(prior) FILTER (WHERE kind = 'weekday'), 0) AS weekday FROM j GROUP BY ALL""")
def fingerprint_pivot(spark, d):
    """How often each mark of an event was seen with its user before, a column a kind."""
    from asofkit.operators import history as H

    f = fingerprint_explode(spark, d)
    keys = ["user_id", "kind", "v"]
    p = H.strict_prior(H.per_time(f, keys, "t", {"n": F.count("*")}), keys, "t", {"prior": "n"})
    return f.join(p, [*keys, "t"]).groupBy("event_id").pivot("kind", ["hour", "type", "weekday"]).agg(F.max("prior")).fillna(0)


@query("SELECT o_orderkey, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 25)::BIGINT AS slot, n_name AS drawn FROM orders JOIN nation ON n_nationkey = ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 25")
def empirical_offset(spark, d):
    """A draw from an indexed pool by a hash of the key alone."""
    slot = F.pmod(F.conv(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(25))
    o = read(spark, d, "orders").select("o_orderkey", slot.alias("slot"))
    return o.join(read(spark, d, "nation"), F.col("slot") == F.col("n_nationkey")).select("o_orderkey", "slot", F.col("n_name").alias("drawn"))


@query("SELECT c_custkey, true AS same FROM customer")
def base58_round_trip(spark, d):
    """Whether 32 bytes come back from their base58 text."""
    from asofkit.functions.binary import base58_decode, base58_encode

    t = F.sha2(F.col("c_custkey").cast("string"), 256)
    return read(spark, d, "customer").select("c_custkey", base58_encode(F.unhex(t)).alias("text")).select("c_custkey", (F.lower(F.hex(base58_decode("text"))) == t).alias("same"))
