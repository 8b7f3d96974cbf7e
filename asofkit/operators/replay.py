"""Exact sequential replay of a constant-product market, one ordered run of trades a key.

The state's products pass 64 bits, so the arithmetic is in Python integers. Trades are dealt by key, sorted within it and
streamed through one function a partition, which holds one market at a time: no call and no frame a key.
"""

from __future__ import annotations

import math
from collections import namedtuple
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the outcomes of a replay
OK = "ok"
NONSTANDARD = "nonstandard_or_unverified_initial_curve"
NO_EXIT = "no_exit_anchor"
OTHER_PROGRAM = "pump_amm_migration_or_entry"
OTHER_SIDE = "unsupported_trade_side"
UNSEEN_CHANGE = "unobserved_reserve_state_transition"
NO_ANCHOR = "anchor_not_found_in_curve_events"
INVALID = "counterfactual_curve_completed_or_invalid"
# fixed values: what a trader keeps when the market has moved, and the relative error of a price that is still taken as equal
INTENTS = ("fixed_quote", "fixed_token")
PRICE_ERROR = 1e-6


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def to_units(value: float, scale: int) -> int:
    """Whole units, rounded half to even."""
    return round(float(value) * scale)


def units(value: Column, scale: int) -> Column:
    """The same of a column."""
    return F.bround(value * scale).cast("long")


@dataclass(frozen=True)
class Market:
    """Virtual and real reserves of the quote and of the token."""

    virtual_quote: int
    virtual_token: int
    real_quote: int
    real_token: int

    def price(self, quote_scale: int = 1, token_scale: int = 1) -> float:
        """Quote for one token, both in whole coins of so many units."""
        return self.virtual_quote / self.virtual_token * token_scale / quote_scale

    def moved(self, quote: int, token: int) -> Market:
        """The state after quote has come in and token has gone out, or the reverse if both are negative."""
        if self.real_token < token or self.real_quote < -quote or quote * token <= 0:
            raise ValueError("the market can't fill this")
        return Market(self.virtual_quote + quote, self.virtual_token - token, self.real_quote + quote, self.real_token - token)

    def buy(self, quote: int) -> tuple[Market, int]:
        """(state, tokens out) for quote paid in; one unit of it is the market's."""
        if quote <= 1:
            raise ValueError("the market can't fill this")
        out = (quote - 1) * self.virtual_token // (self.virtual_quote + quote - 1)
        return self.moved(quote, out), out

    def buy_tokens(self, token: int) -> tuple[Market, int]:
        """(state, quote in) for tokens out."""
        if not 0 < token < self.virtual_token:
            raise ValueError("the market can't fill this")
        quote = ceil_div(token * self.virtual_quote, self.virtual_token - token) + 1
        return self.moved(quote, token), quote

    def sell(self, token: int) -> tuple[Market, int]:
        """(state, quote out) for tokens paid in."""
        if token <= 0:
            raise ValueError("the market can't fill this")
        out = token * self.virtual_quote // (self.virtual_token + token)
        return self.moved(-out, -token), out


def in_order(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """rows dealt by key and sorted within a key by order, nulls last, so that one pass over a partition meets key after key."""
    return rows.repartition(key).sortWithinPartitions(key, *[(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in order])


def _values(column: pa.Array) -> list:
    """Python values; by way of numpy, several times as fast, where the column is of plain numbers without nulls."""
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _whole(values: list) -> list:
    """Whole numbers cut towards zero; null where there is none."""
    return [x if type(x) is int else None if x is None or not math.isfinite(x) else int(x) for x in values]


def _all_units(column: pa.Array, scale: int) -> list:
    """to_units() of every value; null where there is no finite number."""
    with np.errstate(all="ignore"):
        x = np.rint(column.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
        if (np.abs(x) < 2**63).all():
            return x.astype(np.int64).tolist()
    return _whole(x.tolist())


def replay(trades: DataFrame, key: str, order: list[str], start: Market) -> DataFrame:
    """key, trades filled, trades rejected and the last state of each key's market; trades: side ('buy' or 'sell'), amount.

    Trades that order leaves tied go by amount, sales first. One pass over trades in order, in which only the market of
    the key at hand is held; it follows Market.buy() and Market.sell(), without an object a trade.
    """
    rows = trades.withColumn("_buy", F.coalesce(F.col("side") == "buy", F.lit(False)))

    def run(batches):
        none, out = object(), []
        last, kind = none, None
        filled = rejected = vq = vt = rq = rt = 0
        for b in batches:
            kind = b.schema.field(0).type
            for k, buy, amount in zip(_values(b.column(0)), _values(b.column(1)), _whole(_values(b.column(2))), strict=True):
                if k != last and (k == k or last == last):
                    if last is not none:
                        out.append((last, filled, rejected, str(vq), str(vt)))
                    last, filled, rejected = k, 0, 0
                    vq, vt, rq, rt = start.virtual_quote, start.virtual_token, start.real_quote, start.real_token
                if amount is None:
                    rejected += 1
                elif buy:
                    got = (amount - 1) * vt // (vq + amount - 1) if amount > 1 else 0
                    if 0 < got <= rt and rq >= -amount:
                        vq, vt, rq, rt, filled = vq + amount, vt - got, rq + amount, rt - got, filled + 1
                    else:
                        rejected += 1
                else:
                    got = amount * vq // (vt + amount) if amount > 0 else 0
                    if 0 < got <= rq and rt >= -amount:
                        vq, vt, rq, rt, filled = vq - got, vt + amount, rq - got, rt + amount, filled + 1
                    else:
                        rejected += 1
            if out:
                yield _batch(out, [key, "filled", "rejected", "quote_reserve", "token_reserve"], [kind, pa.int32(), pa.int32(), pa.string(), pa.string()])
                out = []
        if last is not none:
            yield _batch([(last, filled, rejected, str(vq), str(vt))], [key, "filled", "rejected", "quote_reserve", "token_reserve"], [kind, pa.int32(), pa.int32(), pa.string(), pa.string()])

    kind = trades.schema[key].dataType.simpleString()
    return in_order(rows, key, [*order, "amount", "_buy"]).select(key, "_buy", "amount").mapInArrow(run, f"`{key}` {kind}, filled int, rejected int, quote_reserve string, token_reserve string")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def cash_flow(net_in: float, gross_out: float, fee: float, rate: float) -> dict[str, float]:
    """Entry with the rate on top, exit with it taken off, and the profit after the fixed fee."""
    entry, exit_ = net_in * (1 + rate), gross_out * (1 - rate)
    return {"entry": entry, "exit": exit_, "pnl": exit_ - entry - fee}


@dataclass(frozen=True)
class Rules:
    """What is replayed: the market at its start, its program, units a coin, stake and fixed fee in coins."""

    start: Market
    program: str = "pump"
    quote_scale: int = 10**9
    token_scale: int = 10**6
    stake: float = 1.0
    fee: float = 0.0


def starts_as_expected(first, rules: Rules) -> tuple[bool, float, float]:
    """(whether a market's first trade fits the expected start, difference of the quote in coins, relative error of the price)."""
    if first.side != "buy" or first.program != rules.program:
        return False, float("nan"), float("nan")
    try:
        after, quote = rules.start.buy_tokens(to_units(first.tokens, rules.token_scale))
    except ValueError:
        return False, float("inf"), float("inf")
    price = float(first.price)
    error = abs(after.price(rules.quote_scale, rules.token_scale) - price) / price
    return error <= PRICE_ERROR, abs(quote - to_units(first.quote, rules.quote_scale)) / rules.quote_scale, error


class _Position:
    """An own position that is being replayed: where it starts and ends, what it has come to, and its own market once it is in."""

    __slots__ = ("end", "entry", "held", "intent", "market", "policy", "out")

    def __init__(self, policy, intent: str):
        self.policy, self.intent, self.entry, self.end, self.market, self.held, self.out = policy, intent, None, None, None, None, None


class _Token:
    """One token's market and the positions asked of it; trades come one by one, in order.

    An own buy is put right after the entry trade and an own sale right after the exit trade. Two markets run side by side: the
    observed one, held against recorded prices, and from the entry on one a position with its own tokens, in which others spend
    the same quote or take the same tokens, by intent. They follow Market.buy(), buy_tokens() and sell(), without an object a trade.
    """

    def __init__(self, token, rules: Rules, intents: tuple[str, ...]):
        self.token, self.rules, self.intents, self.asked, self.done, self.live, self.base, self.worst = token, rules, intents, [], [], None, {}, 0.0
        s = rules.start
        self.seen = (s.virtual_quote, s.virtual_token, s.real_quote, s.real_token)

    def finish(self, p: _Position, status: str, **more) -> None:
        p.out = {**self.base, **more, "status": status}
        self.done.append(p)

    def finish_all(self, status: str, **more) -> None:
        for p in self.live:
            self.finish(p, status, **more)
        self.live = []

    def begin(self, first: _First | None) -> None:
        """Take up the positions asked for, with the first trade; without one there is no market."""
        self.live, fits = [], False
        if first is not None:
            fits, quote_error, price_error = starts_as_expected(first, self.rules)
            self.base = {"quote_error": quote_error, "price_error": price_error}
        for a in self.asked:
            for intent in self.intents:
                p = _Position(a["policy"], intent)
                if not fits:
                    self.finish(p, NONSTANDARD)
                elif a["exit_slot"] is None:
                    self.finish(p, NO_EXIT)
                elif {a["entry_program"], a["exit_program"]} != {self.rules.program}:
                    self.finish(p, OTHER_PROGRAM)
                else:
                    p.entry, p.end = ((a[f"{w}_slot"], a[f"{w}_tx"], a[f"{w}_event"]) for w in ("entry", "exit"))
                    self.live.append(p)

    def trade(self, at: tuple, kind: int, tokens: int | None, price: float) -> None:
        if None in at:
            return self.finish_all(INVALID)
        over = [p for p in self.live if at > p.end]
        if over:
            self.live = [p for p in self.live if at <= p.end]
            for p in over:
                self.finish(p, NO_ANCHOR)
            if not self.live:
                return None
        if kind < _BUY:
            return self.finish_all(OTHER_PROGRAM if kind == _ELSEWHERE else OTHER_SIDE)
        vq, vt, rq, rt = self.seen
        if kind == _BUY:
            if tokens is None or not 0 < tokens < vt or rt < tokens:
                return self.finish_all(INVALID)
            quote = -(-tokens * vq // (vt - tokens)) + 1
            if quote <= 0 or rq < -quote:
                return self.finish_all(INVALID)
            vq, vt, rq, rt = self.seen = (vq + quote, vt - tokens, rq + quote, rt - tokens)
        else:
            quote = tokens * vq // (vt + tokens) if tokens is not None and tokens > 0 else 0
            if not 0 < quote <= rq or rt < -tokens:
                return self.finish_all(INVALID)
            vq, vt, rq, rt = self.seen = (vq - quote, vt + tokens, rq - quote, rt + tokens)
        if price > 0:
            rules = self.rules
            self.worst = max(self.worst, abs(vq / vt * rules.token_scale / rules.quote_scale - price) / price)
            if self.worst > PRICE_ERROR:
                return self.finish_all(UNSEEN_CHANGE, worst_price_error=self.worst)
        ended = False
        for p in self.live:
            if p.held is None:
                if at == p.entry:
                    ended |= self.enter(p)
            else:
                ended |= self.follow(p, at, kind, tokens, quote)
        if ended:
            self.live = [p for p in self.live if p.out is None]
        return None

    def enter(self, p: _Position) -> bool:
        """The own buy, after the trade just seen; true if the position is over."""
        try:
            market, p.held = Market(*self.seen).buy(to_units(self.rules.stake, self.rules.quote_scale))
        except ValueError:
            self.finish(p, INVALID)
            return True
        p.market = (market.virtual_quote, market.virtual_token, market.real_quote, market.real_token)
        return False

    def follow(self, p: _Position, at: tuple, kind: int, tokens: int, quote: int) -> bool:
        """Another's trade in the market with the own tokens, and the own sale if it is the exit; true if the position is over."""
        vq, vt, rq, rt = p.market
        if kind == _SELL:
            out = tokens * vq // (vt + tokens)
            if not 0 < out <= rq or rt < -tokens:
                self.finish(p, INVALID)
                return True
            p.market = (vq - out, vt + tokens, rq - out, rt + tokens)
        else:
            if p.intent == "fixed_quote":
                pays, takes = quote, (quote - 1) * vt // (vq + quote - 1) if quote > 1 else 0
            else:
                takes = tokens if tokens < vt else 0
                pays = -(-takes * vq // (vt - takes)) + 1
            if not 0 < takes <= rt or pays <= 0 or rq < -pays:
                self.finish(p, INVALID)
                return True
            p.market = (vq + pays, vt - takes, rq + pays, rt - takes)
        if at != p.end:
            return False
        try:
            got = Market(*p.market).sell(p.held)[1]
        except ValueError:
            self.finish(p, INVALID)
            return True
        self.finish(p, OK, gross=got / self.rules.quote_scale, held=p.held / self.rules.token_scale, worst_price_error=self.worst)
        return True

    def rows(self, rates: list[float]) -> list[tuple]:
        """What has come of the positions, when there are no more trades."""
        if self.live is None:
            self.begin(None)
        self.finish_all(NO_ANCHOR)
        found, rules = [], self.rules
        for p in self.done:
            for rate in rates:
                got = p.out
                if got["status"] == OK:
                    flow = cash_flow(rules.stake, got["gross"], rules.fee, rate)
                    got = {**got, **flow, "roi": flow["pnl"] / rules.stake}
                found.append((self.token, p.policy, p.intent, rate, got["status"], *[got.get(f) for f in _FIELDS]))
        return found


_FIELDS = ("quote_error", "price_error", "worst_price_error", "entry", "exit", "pnl", "held", "roi")
_First = namedtuple("_First", ["side", "program", "tokens", "quote", "price"])
# fixed values: kinds of a trade; of another program, of the program but neither bought nor sold, bought, sold
_ELSEWHERE, _NEITHER, _BUY, _SELL = range(4)


def replay_positions(trades: DataFrame, anchors: DataFrame, rules: Rules, rates: list[float], intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """A row for each anchor, intent and fee rate: status, and the position's figures where it is ok.

    trades: token, slot, tx, event, side, program, tokens, quote, price; anchors: token, policy, entry_slot, entry_tx, entry_event,
    entry_program and the same of the exit. Both sides are dealt by token once, and a token's anchors come before its trades, so that
    one pass serves all its anchors and holds none of the trades; an anchor without trades has no market. Trades that slot, tx and
    event leave tied go by their other columns.
    """
    place = [F.col(c).cast("long").alias(c) for c in ("slot", "tx", "event")]
    bought = F.when(F.col("side") == "buy", _BUY).when(F.col("side") == "sell", _SELL).otherwise(_NEITHER)
    kind = F.when(F.col("program") == rules.program, bought).otherwise(_ELSEWHERE).cast("int").alias("kind")
    t = trades.select("token", *place, kind, *[F.col(c).cast("double").alias(c) for c in ("tokens", "quote", "price")])
    places = [F.col(f"{w}_{c}").cast("long").alias(f"{w}_{c}") for w in ("entry", "exit") for c in ("slot", "tx", "event")]
    a = anchors.select("token", F.array(F.struct("policy", "entry_program", "exit_program", *places)).alias("anchor"))
    both = in_order(t.unionByName(a, allowMissingColumns=True), "token", [F.col("anchor").isNull(), "slot", "tx", "event", "kind", "tokens", "quote", "price"])
    names = ["token", "policy", "intent", "rate", "status", *_FIELDS]

    def run(batches):
        now, none, kinds = None, object(), None
        last = none
        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            kinds = kinds or [c["token"].type, pa.string(), pa.string(), pa.float64(), pa.string(), *[pa.float64()] * len(_FIELDS)]
            numbers = [c[x].to_numpy(zero_copy_only=False).tolist() for x in ("tokens", "quote", "price")]
            place = list(zip(*[_values(c[x]) for x in ("slot", "tx", "event")], strict=True))
            asked = _values(c["anchor"]) if c["anchor"].null_count < b.num_rows else [None] * b.num_rows
            out = []
            for k, anchor, at, kind, whole, tokens, quote, price in zip(_values(c["token"]), asked, place, _values(c["kind"]), _all_units(c["tokens"], rules.token_scale), *numbers, strict=True):
                if k != last and (k == k or last == last):
                    if now is not None:
                        out += now.rows(rates)
                    last, now = k, _Token(k, rules, intents)
                if anchor is not None:
                    now.asked += anchor
                    continue
                if now.live is None:
                    now.begin(_First("buy" if kind == _BUY else "", rules.program, tokens, quote, price))
                if now.live:
                    now.trade(at, kind, whole, price)
            if out:
                yield _batch(out, names, kinds)
        if now is not None and (out := now.rows(rates)):
            yield _batch(out, names, kinds)

    schema = f"token {anchors.schema['token'].dataType.simpleString()}, policy string, intent string, rate double, status string, " + ", ".join(f"{f} double" for f in _FIELDS)
    return both.mapInArrow(run, schema)


def coverage(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """For each group: replays, those that are ok, their share, and median return and total profit of those."""
    ok = F.col("status") == OK
    return outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.avg(ok.cast("int")).alias("coverage"), F.median(F.when(ok, F.col("roi"))).alias("median_roi"), F.sum(F.when(ok, F.col("pnl"))).alias("total"))
