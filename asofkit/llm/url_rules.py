"""URL filters by association rules, with DataFrame functions only.

Spark's FP-growth mines combinations of URL tokens that come with a label. Rules of enough confidence and support whose
consequent is a label are pruned: a rule goes if part of its tokens gives the same label with at least its confidence.
They are matched by an inverted index from token to rule: a rule fires where all of its tokens are found, and the most confident
rule that fires decides. Fixed rules of host and path come first.

Nulls and edge cases: a null url or one without `://` has an empty host and path and gets the default verdict, as does a
url on which no rule fires; repeated rows agree; a null page_id is kept; without labels nothing is mined; ties between
rules go to more support, then more tokens, then `block`.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 3
#: Mined rules that may be broadcast (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_RULES = 50_000
DEFAULT = "allow"
LABEL = "label="


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first `://` up to / ? # or the end, A-Z in lower case; then up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, `host/path`) rules that fits, null if none."""
    rule = verdict = F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels by their place from the right, path segments by depth, file ending, query keys, fragment."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
            F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.lower(x))),
            F.transform(F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("ending="), F.lower(x))),
            F.transform(query, lambda x: F.concat(F.lit("query="), F.lower(F.regexp_extract(x, r"^([^=]*)", 1)))),
            F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows (tokens, verdict)."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    found = found.where(F.startswith(F.col("consequent")[0], F.lit(LABEL)) & (F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(LABEL))))
    rules = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support")
    # a rule whose tokens hold those of a rule as confident says nothing new: joined by first dropping one or two tokens
    smaller = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    one = F.transform("tokens", lambda x: F.array(x))
    less = F.when(F.size("tokens") > 1, one).otherwise(F.array().cast("array<array<string>>"))
    less = F.concat(less, F.when(F.size("tokens") > 2, F.transform("tokens", lambda x: F.array_remove(F.col("tokens"), x))).otherwise(F.array().cast("array<array<string>>")))
    beaten = rules.select("tokens", "verdict", "confidence", F.explode(less).alias("part")).join(smaller, "part").where("v = verdict and c >= confidence").select("tokens", "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key..., mined_verdict, confidence) of the rule that decides, for pages (page_id, url, tokens) on which one fires."""
    index = rules.select(F.xxhash64("tokens", "verdict").alias("r"), F.size("tokens").alias("size"), "verdict", "confidence", "support", F.explode("tokens").alias("token"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    rows = pages.distinct().select("page_id", "url", F.explode("tokens").alias("token"))
    hits = rows.join(index, "token").groupBy("page_id", "url", "r").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).where("n = size")
    best = F.max(F.struct("confidence", "support", "size", "verdict"))
    return hits.groupBy("page_id", "url").agg(best.alias("b")).select("page_id", "url", F.col("b.verdict").alias("mined_verdict"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence; labels: rows (url, verdict) to mine, else the verdicts of the fixed rules."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "fixed": verdict, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    if labels is None:
        known = rows.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict"))
    else:
        h, p = parts(F.col("url"))
        known = labels.where("url is not null and verdict is not null").select(tokens(F.col("url"), h, p).alias("tokens"), "verdict")
    open_ = rows.where("fixed is null")
    if known.limit(1).count():
        found = match(open_.select("page_id", "url", "tokens"), mine(known)).withColumnsRenamed({"page_id": "_p", "url": "_u"})
        open_ = open_.join(found, open_.page_id.eqNullSafe(F.col("_p")) & open_.url.eqNullSafe(F.col("_u")), "left").drop("_p", "_u")
    else:
        open_ = open_.withColumns({"mined_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    done = rows.where("fixed is not null").withColumns({"mined_verdict": F.lit(None).cast("string"), "confidence": F.lit(1.0)})
    both = done.unionByName(open_)
    return both.select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined_verdict", F.lit(DEFAULT)).alias("verdict"), "confidence")
