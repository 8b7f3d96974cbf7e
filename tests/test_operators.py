"""Operators on small literal tables, with the results worked out by hand."""

import gzip
import json
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from asofkit.functions import binary
from asofkit.functions import expressions as X
from asofkit.operators import asof, audit, evaluation, history, learning, ledger, lifecycle, matching, ranking, replay
from asofkit.sources import tables


def test_state_of_the_same_second_is_not_seen(spark):
    probes = spark.createDataFrame([("w", 100), ("w", 90), (None, 100), ("v", 5)], "wallet string, at long")
    states = spark.createDataFrame([("w", 90, 1), ("w", 99, 2), ("w", 100, 3), ("w", 101, 4), (None, 1, 9)], "wallet string, t long, n long")
    got = {(r.wallet, r["at"]): (r.t, r.n) for r in asof.asof_join(probes, states, ["wallet"], "at", "t", ["n"]).collect()}
    assert got == {("w", 100): (99, 2), ("w", 90): (None, None), (None, 100): (None, None), ("v", 5): (None, None)}
    late = asof.asof_join(probes.where("at = 100 and wallet = 'w'"), states, ["wallet"], "at", "t", ["n"], lag=5).first()
    assert (late.t, late.n) == (90, 1)


def test_horizons_keep_repeated_probes(spark):
    probes = spark.createDataFrame([("w", 100), ("w", 100)], "k string, at long")
    states = spark.createDataFrame([("w", 10, 1), ("w", 95, 2)], "k string, t long, n long")
    got = asof.asof_horizons(probes, states, ["k"], "at", "t", ["n"], {"now_": 0, "ago_": 50}).collect()
    assert [(r.now_n, r.ago_n) for r in got] == [(2, 1), (2, 1)]


def test_prior_counts_leave_out_peers(spark):
    rows = spark.createDataFrame([("w", t) for t in (90, 100, 100, 101)], "k string, t long")
    g = history.per_time(rows, ["k"], "t", {"n": F.count("*")})
    got = history.strict_prior(g, ["k"], "t", {"prior": "n"}).orderBy("t").collect()
    assert [(r.t, r.prior) for r in got] == [(90, 0), (100, 1), (101, 3)]


def test_rolling_window_ends_before_now(spark):
    g = spark.createDataFrame([("w", 0, 1), ("w", 1, 1), ("w", 86400, 1)], "k string, t long, n long")
    assert [r.d for r in history.rolling(g, ["k"], "t", "n", {"d": 86400}).orderBy("t").collect()] == [0, 1, 2]


def test_outcome_counts_when_mature(spark):
    life = spark.createDataFrame([("a", 0, 86399), ("a", 0, 86401)], "k string, start long, outcome long")
    u = {r.t: (r.started, r.matured, r.succeeded) for r in lifecycle.maturity_updates(life, "k", "start", "outcome", 86400).collect()}
    assert u == {0: (2, 0, 0), 86400: (0, 2, 1)}


def test_tied_group(spark):
    m = spark.createDataFrame([("w", 100, 130, 110), ("w", 100, 130, 140), ("w", 100, 130, None)], "k string, t long, now long, sell long")
    r = lifecycle.tied_group_features(m, ["k"], "t", "now", "sell", 86400).first()
    assert (r.group_size, round(r.observed, 6), r.matured_without, r.median_delay) == (3, round(1 / 3, 6), 0, 10)
    late = lifecycle.tied_group_features(m.withColumn("now", F.lit(100 + 86400 + 1)), ["k"], "t", "now", "sell", 86400).first()
    assert (round(late.observed, 6), round(late.matured_without, 6), late.median_delay) == (round(2 / 3, 6), round(1 / 3, 6), 25)


def test_money_sums_alike_in_any_order(spark):
    values = ["56.997300987826", "0.00000000000001", "-0.00000000000001", "abc", ""]
    for v in (values, values[::-1]):
        got = spark.createDataFrame([(x,) for x in v], "v string").agg(ledger.exact_sum(F.col("v")).alias("s")).first().s
        assert str(got) == "56.997300988"


def test_first_match_and_nearest(spark):
    left = spark.createDataFrame([("a", 10), ("b", 10)], "k string, t long")
    ev = spark.createDataFrame([("a", 10, 1), ("a", 12, 2), ("a", 11, 3)], "k string, s long, v int")
    got = {r.k: (r.e_s, r.e_v) for r in matching.first_match(left, ev, ["k"], F.col("s") > F.col("t"), [F.col("s")], ["s", "v"], "e_").collect()}
    assert got == {"a": (11, 3), "b": (None, None)}


def test_pnl_and_drawdown(spark):
    rows = spark.createDataFrame([(1, 1.0, 0), (2, -0.5, 0), (3, 0.25, 0)], "t int, roi double, forced int")
    got = ledger.drawdown(rows.withColumn("p", ledger.outcome_pnl(F.col("roi"), F.col("forced"), 2.0, 0.1)), ["t"], "p").orderBy("t").collect()
    assert [round(r.p, 9) for r in got] == [1.9, -1.1, 0.4]
    assert round(got[-1].equity, 9) == 1.2 and round(max(r.drawdown for r in got), 9) == 1.1


def test_duplicate_key_raises(spark):
    with pytest.raises(Exception, match="duplicate token"):
        ledger.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "token").collect()


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (0, 0.1)], "y int, s double")
    assert evaluation.average_precision(rows, "y", "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert evaluation.roc_auc(rows, "y", "s").first()[0] == pytest.approx((6 - 0.5) / 6)
    assert [r.pr for r in ranking.percent_rank_average(rows, "s", "pr").orderBy("s").collect()] == [0.3, 0.3, 0.7, 0.7, 1.0]


def test_market_quotes_are_exact():
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(300):
        vq, vt = (int(x) for x in rng.integers(10**6, 10**12, 2))
        m = replay.Market(vq, vt, vq // 3, vt // 2)
        paid = int(rng.integers(2, 10**6))
        out = (paid - 1) * vt // (vq + paid - 1)
        if 0 < out <= vt // 2:
            after, got = m.buy(paid)
            assert got == out and after.real_token == m.real_token - out and after.virtual_quote * after.virtual_token >= vq * vt
            same, quote = m.buy_tokens(out)
            assert quote <= paid and same.virtual_token == after.virtual_token and m.buy(quote)[1] >= out - 1
            back, quote_out = after.sell(out)
            assert quote_out < paid and back.virtual_token == vt and quote_out == out * after.virtual_quote // (after.virtual_token + out)
    for bad in (lambda m: m.buy(1), lambda m: m.buy(10**18), lambda m: m.buy_tokens(0), lambda m: m.buy_tokens(10**13), lambda m: m.sell(0), lambda m: m.sell(10**15)):
        with pytest.raises(ValueError):
            bad(replay.Market(10**9, 10**12, 0, 10**11))
    assert replay.Market(2, 4, 0, 0).price() == 0.5 and replay.to_units(0.5, 1) == 0 and replay.to_units(1.5, 1) == 2
    flow = replay.cash_flow(2.0, 3.0, 0.25, 0.5)
    assert flow == {"entry": 3.0, "exit": 1.5, "pnl": -1.75}


def _trades(start, steps, scale=1000):
    """Trades in whole coins with the prices that they lead to."""
    m, rows = start, []
    for i, (side, tokens) in enumerate(steps):
        m, quote = m.buy_tokens(tokens * scale) if side == "buy" else m.sell(tokens * scale)
        rows.append(("k", 1, i, 0, side, "pump", float(tokens), quote / scale, m.price(scale, scale)))
    return rows


def test_positions_in_a_replayed_market(spark):
    start = replay.Market(5_000_000, 40_000_000, 0, 30_000_000)
    rules = replay.Rules(start, "pump", 1000, 1000, 300.0, 1.0)
    steps = [("buy", 900), ("buy", 500), ("buy", 1200), ("sell", 400), ("buy", 700)]
    good = _trades(start, steps)
    anchor = ("k", "p", 1, 1, 0, "pump", 1, 4, 0, "pump")
    names = "token string, policy string, entry_slot long, entry_tx long, entry_event long, entry_program string, exit_slot long, exit_tx long, exit_event long, exit_program string"

    def run(rows, a=anchor, intents=replay.INTENTS):
        t = spark.createDataFrame(rows, "token string, slot long, tx long, event long, side string, program string, tokens double, quote double, price double")
        return {r.intent: r for r in replay.replay_positions(t, spark.createDataFrame([a], names), rules, [0.01], intents).collect()}

    got = run(good)
    for intent in replay.INTENTS:  # by hand: own buy after the second trade, own sale after the last
        m = start.buy_tokens(900_000)[0].buy_tokens(500_000)[0]
        seen, (m, held) = m, m.buy(300_000)
        for side, n in steps[2:]:
            was = seen
            seen, quote = was.buy_tokens(n * 1000) if side == "buy" else was.sell(n * 1000)
            m = m.sell(n * 1000)[0] if side == "sell" else m.buy(quote)[0] if intent == "fixed_quote" else m.buy_tokens(n * 1000)[0]
        gross = m.sell(held)[1] / 1000
        assert got[intent].status == "ok" and got[intent].held == held / 1000 and got[intent].pnl == pytest.approx(gross * 0.99 - 303 - 1)
    assert got["fixed_token"].pnl != got["fixed_quote"].pnl
    change = lambda i, **k: [tuple({**dict(zip(("token", "slot", "tx", "event", "side", "program", "tokens", "quote", "price"), r, strict=True)), **(k if j == i else {})}.values()) for j, r in enumerate(good)]
    one = lambda *a: run(*a, intents=("fixed_token",))["fixed_token"].status
    assert one(change(0, price=9.0)) == replay.NONSTANDARD and one(change(0, side="sell")) == replay.NONSTANDARD
    assert one(good, (*anchor[:6], None, None, None, None)) == replay.NO_EXIT
    assert one(good, (*anchor[:9], "other")) == replay.OTHER_PROGRAM and one(change(3, program="other")) == replay.OTHER_PROGRAM
    assert one(change(2, side="burn")) == replay.OTHER_SIDE
    assert one(change(2, price=9.0)) == replay.UNSEEN_CHANGE
    assert one(good, (*anchor[:6], 1, 9, 0, "pump")) == replay.NO_ANCHOR
    assert one(change(3, tokens=1e9, price=0.0)) == replay.INVALID


def test_running_totals_need_no_single_task(spark):
    rng = np.random.Generator(np.random.PCG64(12))
    v = [None, float("nan"), *[float(x) for x in rng.integers(0, 50, 400)]]
    df = spark.createDataFrame([(i, x, int(i % 7)) for i, x in enumerate(v)], "id long, v double, n long")
    for down in (False, True):
        got = {r.id: r.s for r in ranking.running_totals(df, "v", {"s": F.col("n")}, ["id"], down, 8).collect()}
        plain = [i for i in range(len(v)) if i > 1]
        order = sorted(plain, key=lambda i: (-v[i] if down else v[i], i))
        low = sum(i % 7 for i in (0, 1)) if not down else 0
        want, total = {}, low
        for i in order:
            total += i % 7
            want[i] = total
        assert {i: got[i] for i in plain} == want
    moved = learning.permuted(df, "n", "id", "salt").toPandas()
    assert sorted(moved.n) == sorted(i % 7 for i in range(len(v))) and (moved.set_index("id").n.sort_index().to_numpy() != np.arange(len(v)) % 7).any()
    bucket = df.where("v > 0").withColumn("b", F.col("id") % 3)
    top = ranking.top_share_per_bucket(bucket, "b", "v", "id", 0.2).toPandas()
    for b, g in bucket.toPandas().groupby("b"):
        want = g[g.v.notna()].sort_values(["v", "id"], ascending=[False, True])
        assert set(top[top.b == b].id) >= set(want.id[: round(0.2 * len(want)) - 1])


def test_probes_without_a_key_match_nothing(spark):
    probes = spark.createDataFrame([(None, 5), ("a", 5), ("a", 5), ("a", None), ("b", 1)], "k string, t long")
    states = spark.createDataFrame([(None, 1, 9), ("a", 3, 1), ("a", 5, 2), ("a", None, 7)], "k string, at long, v long")
    got = sorted(((r.k or "", r.t or -1, r.x_v, r.y_v) for r in asof.asof_horizons(probes, states, ["k"], "t", "at", ["v"], {"x_": 0, "y_": 2}).collect()), key=str)
    assert got == sorted([("", 5, None, None), ("a", 5, 1, None), ("a", 5, 1, None), ("a", -1, None, None), ("b", 1, None, None)], key=str)


def test_sinks_footers_and_models(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, float(i) if i % 5 else None) for i in range(100)], "a long, b double")
    tables.batched(df.coalesce(1), str(tmp_path / "t"), 30)
    f = {r.column: r for r in tables.footers(spark, str(tmp_path / "t")).collect()}
    assert (f["a"].rows, f["a"].least, f["a"].greatest, f["b"].nulls, f["b"].least) == (100, "0", "99", 20, "1.0")
    for single in (True, False):
        tables.write_csv(df, str(tmp_path / "c"), ["a"], single)
        assert tables.csv(spark, str(tmp_path / "c"), "a long, b double").agg(F.sum("a"), F.count("b")).first() == (4950, 80)
    for n in (1, 2):  # a second document takes the place of the first
        tables.write_json(spark, {"n": n}, str(tmp_path / "x.json"))
        assert tables.read_json(spark, str(tmp_path / "x.json")) == {"n": n}
    assert [tuple(r) for r in tables.column_dictionary(df, {"b": "note"}).collect()] == [(0, "a", "bigint", None), (1, "b", "double", "note")]
    with pytest.raises(ValueError):
        tables.column_dictionary(df, {"z": ""})
    assert tables.input_path("events", "/d", spark) == "/d"
    monkeypatch.setenv("ASOFKIT_EVENTS", "/e")
    assert tables.input_path("events", "/d", spark) == "/e"
    rows = learning.prepare(df.withColumn("y", (F.col("a") > 50).cast("int")), ["b"], "y")
    model = learning.fit(rows, ["b"], "y")
    learning.save(model, str(tmp_path / "m"))
    again = learning.predict(learning.load(str(tmp_path / "m")), rows)
    assert [r.score for r in again.orderBy("a").collect()] == [r.score for r in learning.predict(model, rows).orderBy("a").collect()]


def test_contracts_of_joins_and_gates(spark):
    from asofkit.operators import augment, selection

    left = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="duplicate"):
        augment.augment(left, twice, ["k"], "v").collect()
    with pytest.raises(ValueError):
        augment.from_sources(left, ["k"], {}, {"x": True})
    assert selection.feature_gate({"score": 0.5}, {"a": 0.4, "b": 0.495}, 0.01) == {"a": "KEEP", "b": "DROP"}
    assert selection.available(left, {"g": ["k", "z"], "h": ["k"]}, ["g", "h"]) == ["k"]


def test_binary_records(spark):
    tag = b"ABCDEFGH"
    data = tag + struct.pack("<Q", 2**63 + 5) + struct.pack("<I", 3) + b"abc" + bytes(31) + b"\x01"
    decode = binary.record_decoder(tag, [("n", "Q"), ("name", "s"), ("key", "k")])
    rows = spark.createDataFrame([(data,), (data[:-1],), (None,)], "b binary").select(decode("b").alias("r")).collect()
    assert (int(rows[0].r.n), rows[0].r.name, rows[0].r.key) == (2**63 + 5, "abc", "1" * 31 + "2")
    assert rows[1].r.n is None and rows[2].r.n is None
    assert binary.base58_bytes(binary.base58_text(b"\0\0hello")) == b"\0\0hello"


def test_expressions(spark):
    r = spark.createDataFrame([("  A  b ", "https://www.Ex.com:80/x")], "t string, u string").select(
        X.normalized(F.col("t")).alias("n"), X.word_count(F.col("t")).alias("w"), X.host(F.col("u")).alias("h"), X.median_of(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(9))).alias("m"), X.joined_distinct(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("j")
    ).first()
    assert (r.n, r.w, r.h, r.m, r.j) == ("a b", 2, "ex.com", 2.5, "a|b")


def test_sources(spark, tmp_path):
    rows = [json.dumps({"a": i, "b": {"c": str(i)}}) for i in range(50)]
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress("\n".join(rows).encode()))
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(rows).encode()))
    schema = "a long, b struct<c:string>"
    for df in (tables.json_lines(spark, str(tmp_path / "x.jsonl.gz"), schema, 4), tables.zstd_json_lines(spark, str(tmp_path / "x.jsonl.zst"), schema)):
        assert df.agg(F.sum("a"), F.max("b.c")).first() == (1225, "9")
    built = []
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.build_or_reuse(spark, path, lambda: built.append(1) or spark.range(10))
    assert len(built) == 1 and tables.manifest(spark, path, [path], "n")["rows"] == 10
    tables.write_json(spark, {"a": 1}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    (tmp_path / "i.html").write_text('<a href="f1.zst">f1.zst</a> 2025 123\n<a href="f2.zst">f2.zst</a> 2025 456\n')
    assert {tuple(r) for r in tables.listing(spark, str(tmp_path / "i.html")).collect()} == {("f1.zst", 123), ("f2.zst", 456)}
    stats = {r.column: (r.least, r.greatest, r.nulls) for r in tables.column_statistics(spark.range(5)).collect()}
    assert stats == {"id": ("0", "4", 0)}
    tables.write_sorted(spark.range(100), str(tmp_path / "s"), ["id"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    assert tables.inventory(spark, str(tmp_path / "s")).count() > 0


def test_audits(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "a int, b int")
    assert tuple(audit.duplicate_keys(df, ["a", "b"]).first()) == (3, 2, 1)
    with pytest.raises(ValueError, match="small"):
        audit.require(df, {"small": F.col("a") < 2})
    assert audit.checksum(df, ["a", "b"]).first() == audit.checksum(df.orderBy("b"), ["a", "b"]).first()
    with pytest.raises(ValueError):
        audit.require_columns(df, {"a", "z"})


def test_regimes(spark):
    from asofkit.operators import regimes

    df = spark.createDataFrame([("a", 1, 0.9, 1.0), ("a", 0, 0.8, 2.0), ("a", 1, 0.7, 3.0), ("b", 0, 0.6, 4.0), ("b", 0, 0.2, None)], "p string, y int, s double, x double")
    ap = {r.p: r.average_precision for r in regimes.average_precision_by(df, "p", "y", "s").collect()}
    assert ap["a"] == pytest.approx((1 + 2 / 3) / 2) and ap["b"] == 0
    got = {r.p: r for r in regimes.regimes(df, "p", "y", "s", 0.75).collect()}
    assert (got["a"].selected, got["a"].hits, got["a"].own_threshold) == (2, 1, 0.7) and (got["b"].selected, got["b"].f1) == (0, 0)
    rows = {(r.p, r.factor): (r.selected, r.hits) for r in regimes.threshold_sensitivity(df, "p", "y", "s", 0.4, [0.5, 1.0, 2.0]).collect()}
    assert rows == {("a", 0.5): (3, 2), ("a", 1.0): (3, 2), ("a", 2.0): (2, 1), ("b", 0.5): (2, 0), ("b", 1.0): (1, 0), ("b", 2.0): (0, 0)}
    assert {(r.n, r.direction) for r in regimes.feature_effects(df, "x", "y", "s", 2).collect()} == {(2, "decreasing")}
    assert regimes.regimes(df.limit(0), "p", "y", "s", 0.5).count() == 0


def test_promotion():
    from asofkit.operators import promotion

    assert promotion.decide({"ap": 0.3}, {"ap": 0.2}, {"ap": 0.05})[0] == "PROMOTE"
    assert promotion.decide({"ap": 0.3}, {"ap": 0.2}, {"ap": 0.05, "f1": 0}) == ("REJECT", {"ap": True, "f1": False})
    frozen = promotion.freeze({"a": 1, "b": [2]})
    promotion.verify(frozen)
    with pytest.raises(ValueError):
        promotion.verify({**frozen, "a": 2})
    promotion.require_metrics({"n": 3, "x": 0.1 + 1e-9}, {"n": 3, "x": 0.1}, 1e-6)
    with pytest.raises(ValueError, match="n"):
        promotion.require_metrics({"n": 4}, {"n": 3}, 10)


def test_reconcile(spark):
    parts = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (4, 1.0)], "k int, v double")
    whole = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 1.0)], "k int, t double")
    assert tuple(audit.reconcile(parts, whole, ["k"], "v", "t", 1e-9).first()) == (1, 1, 1)


def test_count_below_takes_whole_tables(spark):
    left = spark.createDataFrame([(i, float(i % 50)) for i in range(300)] + [(900, None), (901, -5.0), (7, 3.0)], "k long, v double")
    right = spark.createDataFrame([(float(i % 40),) for i in range(1000)] + [(3.0,)] * 500 + [(None,)], "w double")
    got = {r.k: r.n for r in matching.count_below(left, "k", "v", right, "w", "n", parts=7).collect()}
    values = [float(i % 40) for i in range(1000)] + [3.0] * 500
    want = {}
    for k, v in [(i, float(i % 50)) for i in range(300)] + [(900, None), (901, -5.0), (7, 3.0)]:
        want[k] = want.get(k, 0) + (sum(w < v for w in values) if v is not None else 0)
    assert got == want
    assert [r.n for r in matching.count_below(left.limit(1), "k", "v", right.limit(0), "w", "n").collect()] == [0]


def test_theta_left_join_has_every_supplier(spark):
    import asofkit.plans as plans

    sf = "/root/testdata/sf0.01"
    got = plans.QUERIES["theta_left_join"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").distinct().count() > 20


def test_categories_are_filled_and_unknown_ones_are_zero(spark):
    from asofkit.operators import learning

    rows = [(float(k % 7), "it's" if k % 3 else "b", int(k % 3 > 0)) for k in range(60)] + [(1.0, None, 1)]
    df = learning.prepare(spark.createDataFrame(rows, "x double, c string, y int"), ["x"], "y")
    model = learning.fit(df, ["x"], "y", categories=["c"])
    asked = learning.prepare(spark.createDataFrame([(1.0, "it's", 1), (1.0, "b", 0), (1.0, None, 1), (1.0, "new", 0)], "x double, c string, y int"), ["x"], "y")
    got = [(r.c, r.c_hot.toArray().tolist(), r.score) for r in learning.predict(model, asked).collect()]
    assert [h for _, h, _ in got] == [[0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    assert got[0][2] > 0.5 > got[1][2]


def test_first_component_and_list_overlap(spark):
    df = spark.createDataFrame([(float(k), float(k**3), float(-k)) for k in range(20)], "a double, b double, c double")
    assert ranking.first_component_share(df, ["a", "b", "c"]) == pytest.approx(1.0)
    free = spark.createDataFrame([(float(i), float(j)) for i in range(4) for j in range(4)], "a double, b double")
    assert ranking.first_component_share(free, ["a", "b"]) == pytest.approx(0.5)
    # b's null stands at the mean: ranks standardised over their own values, then correlated over all four rows
    gaps = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, 3.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    za, zb = [-1.5, -0.5, 0.5, 1.5], [-1.0, 0.0, 1.0, 0.0]
    r = sum(x * y for x, y in zip(za, zb, strict=True)) / (sum(x * x for x in za) * sum(y * y for y in zb)) ** 0.5
    assert ranking.first_component_share(gaps, ["a", "b", "c"]) == pytest.approx((1 + r) / 2)
    assert ranking.first_component_share(gaps, ["a", "c"]) == 1.0
    lists = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(ranking.list_jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0, None]


def test_a_floor_that_no_threshold_reaches_has_no_row(spark):
    rows = spark.createDataFrame([(0, 3), (1, 2), (0, 1)], "y int, s long")
    got = {r.rule: (r.threshold, r.precision, r.recall) for r in evaluation.best_threshold(rows, "y", "s", [0.5, 0.9]).collect()}
    assert got == {"max_f1": (2, 0.5, 1.0), "recall_at_0.5": (2, 0.5, 1.0)}
    assert evaluation.best_threshold(rows.where("s > 9"), "y", "s", [0.0]).count() == 0


def test_many_markets_in_few_calls(spark):
    """Markets of many keys are replayed in one pass a partition, and give what one market after the other gives."""
    rng = np.random.Generator(np.random.PCG64(21))
    start = replay.Market(10**13, 10**15, 10**12, 8 * 10**14)
    rows = [(int(k), int(at), "sell" if s else "buy", None if a == 0 else int(a) * 10**8) for at, (k, s, a) in enumerate(zip(rng.integers(0, 700, 30_000), rng.integers(0, 2, 30_000), rng.integers(0, 90_000, 30_000), strict=True))]
    rows = [*rows, (None, 1, "buy", 2**60), (None, 2, "sell", 2**62 + 1), (None, 3, None, 5), (701, 1, "buy", 1)]
    want = {}
    for k, _, side, amount in sorted(rows, key=lambda r: r[1]):
        m, filled, rejected = want.get(k, (start, 0, 0))
        try:
            if amount is None:
                raise ValueError
            want[k] = (m.buy(amount)[0] if side == "buy" else m.sell(amount)[0], filled + 1, rejected)
        except ValueError:
            want[k] = (m, filled, rejected + 1)
    t = spark.createDataFrame(rows, "k long, at long, side string, amount long")
    got = replay.replay(t, "k", ["at"], start)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {r.k: (r.filled, r.rejected, r.quote_reserve, r.token_reserve) for r in got.collect()} == {k: (f, x, str(m.virtual_quote), str(m.virtual_token)) for k, (m, f, x) in want.items()}


def test_positions_of_many_tokens_in_one_pass(spark):
    rng = np.random.Generator(np.random.PCG64(22))
    start = replay.Market(5_000_000, 40_000_000, 0, 30_000_000)
    rules = replay.Rules(start, "pump", 1000, 1000, 300.0, 1.0)
    trades, anchors, want = [], [], {}
    for token in range(300):
        steps = [("buy", int(rng.integers(1, 6000))), *[(("buy", "sell")[int(rng.integers(0, 2))], int(rng.integers(1, 6000))) for _ in range(int(rng.integers(1, 12)))]]
        m, filled = start, []
        for side, n in steps:
            try:
                m = m.buy_tokens(n * 1000)[0] if side == "buy" else m.sell(n * 1000)[0]
            except ValueError:
                continue
            filled.append((side, n, m.price(1000, 1000)))
        trades += [(token, 1, i, 0, side, "pump", float(n), 0.0, price) for i, (side, n, price) in enumerate(filled)]
        for policy, entry in (("early", 0), ("late", 1)):
            end = len(filled) - 1
            anchors.append((token, policy, 1, entry, 0, "pump", 1, end, 0, "pump"))
            for intent in replay.INTENTS:
                seen = own = start
                held, status = None, replay.NO_ANCHOR
                try:
                    for i, (side, n, _) in enumerate(filled):
                        seen, quote = seen.buy_tokens(n * 1000) if side == "buy" else seen.sell(n * 1000)
                        if held is None:
                            if i == entry:
                                own, held = seen.buy(300_000)
                            continue
                        own = own.sell(n * 1000)[0] if side == "sell" else own.buy(quote)[0] if intent == "fixed_quote" else own.buy_tokens(n * 1000)[0]
                    if held is not None and end > entry:
                        own.sell(held)
                        status = replay.OK
                except ValueError:
                    held, status = None, replay.INVALID
                want[token, policy, intent] = status, held / 1000 if status == replay.OK else None
    anchors.append((999, "early", 1, 0, 0, "pump", 1, 1, 0, "pump"))
    want |= {(999, "early", i): (replay.NONSTANDARD, None) for i in replay.INTENTS}
    t = spark.createDataFrame(trades, "token long, slot long, tx long, event long, side string, program string, tokens double, quote double, price double")
    a = spark.createDataFrame(anchors, "token long, policy string, entry_slot long, entry_tx long, entry_event long, entry_program string, exit_slot long, exit_tx long, exit_event long, exit_program string")
    got = replay.replay_positions(t, a, rules, [0.01])
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert {(r.token, r.policy, r.intent): (r.status, r.held) for r in got.collect()} == want
    assert len({s for s, _ in want.values()}) == 4
