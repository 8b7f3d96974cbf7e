"""Row-level expressions: lists, ranges, text profiles, structs in arrays, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import expressions as X
from asofkit.operators import selection as S
from asofkit.plans.registry import query, read


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, d):
    return read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS inside FROM lineitem WHERE l_discount NOT BETWEEN 0.02 AND 0.04")
def between_ranges(spark, d):
    li = read(spark, d, "lineitem").where(~F.col("l_discount").between(0.02, 0.04))
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").between(10, 20).alias("inside"))


@query("SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) / 86400000000.0 AS days, round(ln(1 + o_totalprice), 9) AS log_price, round_even(o_totalprice * 10, 0)::BIGINT AS tenths, round_even(o_totalprice * 1000, 0)::BIGINT AS quantized FROM orders")
def scaled_numbers(spark, d):
    """Days since a moment, log1p, and whole units rounded half to even."""
    day = (X.seconds(F.col("o_orderdate")) - 694224000) / 86400
    return read(spark, d, "orders").select("o_orderkey", day.alias("days"), F.round(F.log1p("o_totalprice"), 9).alias("log_price"), F.bround(F.col("o_totalprice") * 10).cast("long").alias("tenths"), S.quantized(F.col("o_totalprice"), 3).alias("quantized"))


_NAME = "substr(coalesce(text, ''), 1, 60)"
_URI = "'https://www.' || source || CASE lang WHEN 'en' THEN '.ipfs.io' WHEN 'de' THEN '.arweave.net' WHEN 'fr' THEN '.github.io' ELSE '.org' END || '/' || doc_id"


@query(rf"""WITH p AS (SELECT doc_id, {_NAME} AS name, coalesce(source, '') AS symbol, coalesce({_URI}, '') AS uri FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS name_normalized, regexp_replace(lower(symbol), '\s+', '', 'g') AS symbol_normalized FROM p)
SELECT doc_id, name_normalized, symbol_normalized, length(name) AS name_length, length(symbol) AS symbol_length, length(uri) AS uri_length, len(list_filter(regexp_split_to_array(name, '\s+'), lambda x: x <> '')) AS name_words,
 length(regexp_replace(name, '[^0-9]', '', 'g')) AS name_digits, length(regexp_replace(symbol, '[^0-9]', '', 'g')) AS symbol_digits, length(regexp_replace(name, '[\x00-\x7F]', '', 'g')) AS name_non_ascii, length(regexp_replace(symbol, '[\x00-\x7F]', '', 'g')) AS symbol_non_ascii,
 round(length(regexp_replace(name, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(name, '[^\p{{L}}]', '', 'g')), 1), 9) AS name_upper, round(length(regexp_replace(symbol, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(symbol, '[^\p{{L}}]', '', 'g')), 1), 9) AS symbol_upper,
 replace(name_normalized, ' ', '') = symbol_normalized AS same_name, contains(name_normalized, 'http://') OR contains(name_normalized, 'https://') OR contains(name_normalized, '.com') AS name_has_url, contains(name, '$') OR contains(symbol, '$') AS has_dollar,
 length(regexp_replace(name, '[\x00-\x7F]', '', 'g')) > 0 AS name_special, length(regexp_replace(symbol, '[\x00-\x7F]', '', 'g')) > 0 AS symbol_special, regexp_replace(regexp_extract(lower(uri), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host,
 CASE WHEN contains(lower(uri), 'ipfs') THEN 'ipfs' WHEN contains(lower(uri), 'arweave') THEN 'arweave' WHEN contains(lower(uri), 'github') THEN 'github' WHEN uri = '' THEN 'missing' ELSE 'other' END AS provider, length(trim(symbol)) > 0 AS has_symbol FROM n""")
def text_profile(spark, d):
    """What a name, a symbol and a link look like."""
    t = read(spark, d, "documents")
    top = F.when(F.col("lang") == "en", ".ipfs.io").when(F.col("lang") == "de", ".arweave.net").when(F.col("lang") == "fr", ".github.io").otherwise(".org")
    p = t.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("name"), F.coalesce("source", F.lit("")).alias("symbol"), F.coalesce(F.concat(F.lit("https://www."), "source", top, F.lit("/"), F.col("doc_id").cast("string")), F.lit("")).alias("uri"))
    return p.select("doc_id", *X.text_profile(F.col("name"), F.col("symbol"), F.col("uri"), {"ipfs": "ipfs", "arweave": "arweave", "github": "github"}))


@query(r"SELECT DISTINCT e, regexp_extract(e, '^offset_(-?\d+)$', 1) AS digits, TRY_CAST(nullif(regexp_extract(e, '^offset_(-?\d+)$', 1), '') AS INT) AS slots FROM (SELECT 'offset_' || l_linenumber AS e FROM lineitem UNION ALL SELECT l_returnflag FROM lineitem)")
def prefix_parse(spark, d):
    li = read(spark, d, "lineitem")
    names = li.select(F.concat(F.lit("offset_"), F.col("l_linenumber").cast("string")).alias("e")).union(li.select("l_returnflag")).distinct()
    return names.select("e", F.regexp_extract("e", r"^offset_(-?\d+)$", 1).alias("digits"), X.after_prefix(F.col("e"), "offset_").alias("slots"))


@query("""WITH g AS (SELECT l_orderkey, list({k: l_partkey, q: l_quantity, f: l_returnflag} ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS xs FROM lineitem GROUP BY ALL)
SELECT l_orderkey, len(xs) AS n, len(list_filter(xs, lambda x: x.f = 'R')) AS returned, list_sum(list_transform(list_filter(xs, lambda x: x.f <> 'R'), lambda x: x.q::BIGINT))::BIGINT AS kept, list_max(list_transform(list_filter(xs, lambda x: x.f <> 'R'), lambda x: x.q)) AS most, xs[1].k AS first_part,
 array_to_string(list_transform(list_filter(xs, lambda x, i: NOT list_contains(list_transform(xs[:i - 1], lambda y: y.f), x.f)), lambda x: x.f), '>') AS flags FROM g""")
def structs_in_arrays(spark, d):
    """Counts, sums, extremes, first elements and ordered distinct values within an array of structs."""
    li = read(spark, d, "lineitem")
    member = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_returnflag")
    xs = F.col("xs")
    kept = F.transform(F.filter(xs, lambda x: x["l_returnflag"] != "R"), lambda x: x["l_quantity"])
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("xs"))
    return g.select(
        "l_orderkey", F.size(xs).cast("long").alias("n"), F.size(F.filter(xs, lambda x: x["l_returnflag"] == "R")).cast("long").alias("returned"), F.when(F.size(kept) > 0, total).alias("kept"), F.array_max(kept).alias("most"),
        F.element_at(xs, 1)["l_partkey"].alias("first_part"), F.array_join(F.array_distinct(F.transform(xs, lambda x: x["l_returnflag"])), ">").alias("flags"),
    )


@query("SELECT p_partkey, json_extract_string(j, '$.a.brand') AS brand, coalesce(json_extract_string(j, '$.a.none'), '-') AS missing, coalesce(TRY_CAST(json_extract_string(j, '$.size') AS INT), 0) AS size FROM (SELECT p_partkey, '{\"a\": {\"brand\": \"' || p_brand || '\"}, \"size\": ' || p_size || '}' AS j FROM part)")
def nested_defaults(spark, d):
    """Members of nested JSON, with defaults for what isn't there."""
    j = F.concat(F.lit('{"a": {"brand": "'), F.col("p_brand"), F.lit('"}, "size": '), F.col("p_size").cast("string"), F.lit("}"))
    get = lambda p: F.get_json_object("j", p)
    return read(spark, d, "part").select("p_partkey", j.alias("j")).select("p_partkey", get("$.a.brand").alias("brand"), F.coalesce(get("$.a.none"), F.lit("-")).alias("missing"), F.coalesce(get("$.size").try_cast("int"), F.lit(0)).alias("size"))
