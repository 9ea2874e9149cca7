"""Fills, orders, positions, exposure: reconciliation, ordered folds, top-k."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold, same_key
from ..functions.quantiles import exact_quantiles
from ..functions.windows import micros, ratio

MATCH_KEY = ["order_id", "symbol", "side", "venue"]


def _compared(price_tol: float, qty_tol: float, drift_ms: float) -> Column:
    """The first check that fails of quantity, price and time, or matched."""
    drift = F.abs(F.col("i_us") - F.col("x_us")) / 1000
    return (
        F.when(F.abs(F.col("i_quantity") - F.col("x_quantity")) > qty_tol, "quantity")
        .when(F.abs(F.col("i_price") - F.col("x_price")) > price_tol, "price")
        .when(drift > drift_ms, "timestamp_drift")
        .otherwise("matched")
    )


def match_fills(internal: DataFrame, exchange: DataFrame, price_tol: float = 0.01, qty_tol: float = 0.001, drift_ms: float = 1000.0) -> DataFrame:
    """(internal_id, exchange_id, result): matched, or the first failing check of a comparison, by the rule of arrival.

    Fills arrive in the order (ts, internal before exchange, fill_id).  Each one is compared with the first fill of the other side
    and the same key that has arrived and is not matched yet; a match takes both away, a break leaves both waiting, so that
    a fill may be in several breaks and still be matched.  A null in a key equals another null.

    Both sides meet in one exchange by key.  Keys with one fill on each side (the usual case) are compared in an
    aggregate; the others are read as one stream that holds the fills of one key which wait.
    """
    pick = lambda df, side: df.select(*MATCH_KEY, F.lit(side).alias("_x"), "fill_id", micros("ts").alias("us"), "quantity", "price")
    both = pick(internal, False).unionByName(pick(exchange, True)).repartition(*MATCH_KEY)
    key = Window.partitionBy(*MATCH_KEY)
    n = both.withColumn("_a", F.count(F.when(~F.col("_x"), 1)).over(key)).withColumn("_b", F.count(F.when(F.col("_x"), 1)).over(key))
    side = lambda p, c: F.max(F.when(F.col("_x") if p == "x" else ~F.col("_x"), F.col(c))).alias(f"{p}_{c}")
    single = n.filter("_a = 1 and _b = 1").groupBy(*MATCH_KEY).agg(*(side(p, c) for p in "ix" for c in ("fill_id", "us", "quantity", "price")))
    fast = single.select(F.col("i_fill_id").alias("internal_id"), F.col("x_fill_id").alias("exchange_id"), _compared(price_tol, qty_tol, drift_ms).alias("result"))
    many = n.filter("_a > 0 and _b > 0 and _a + _b > 2").sortWithinPartitions(*MATCH_KEY, "us", "_x", "fill_id")

    def compared(a: tuple, b: tuple) -> str:
        if abs(a[2] - b[2]) > qty_tol:
            return "quantity"
        if abs(a[3] - b[3]) > price_tol:
            return "price"
        return "timestamp_drift" if abs(a[1] - b[1]) / 1000 > drift_ms else "matched"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, waiting = None, (deque(), deque())
        for batch in batches:
            out = []
            for *k, theirs, fill_id, us, quantity, price in batch.itertuples(index=False, name=None):
                if not same_key(k, last):
                    last, waiting = k, (deque(), deque())
                fill, own, other = (fill_id, us, quantity, price), waiting[theirs], waiting[not theirs]
                result = compared(fill, other[0]) if other else None
                if result:
                    ids = (other[0][0], fill_id) if theirs else (fill_id, other[0][0])
                    out.append((*ids, result))
                if result == "matched":
                    other.popleft()
                else:
                    own.append(fill)
            yield pd.DataFrame(out, columns=["internal_id", "exchange_id", "result"])

    slow = many.select(*MATCH_KEY, "_x", "fill_id", "us", "quantity", "price").mapInPandas(fold, "internal_id string, exchange_id string, result string")
    return fast.unionByName(slow)


def missing_fills(internal: DataFrame, exchange: DataFrame, matches: DataFrame, as_of: str, max_age_s: float = 60.0) -> DataFrame:
    """(break_id, fill_id, kind, severity): fills without a match that are older than the limit; the matches are read once for both sides."""
    ends = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("fill_id")) for kind, c in (("missing_exchange", "internal_id"), ("missing_internal", "exchange_id")))))
    done = matches.filter("result = 'matched'").select(ends.alias("e")).select("e.kind", "e.fill_id")
    old = (micros(F.to_timestamp_ntz(F.lit(as_of))) - micros("ts")) / 1e6 > max_age_s
    pick = lambda df, kind, severity: df.filter(old).select("fill_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    both = pick(internal, "missing_exchange", "high").unionByName(pick(exchange, "missing_internal", "critical"))
    ident = F.substring(F.md5(F.concat_ws(":", "kind", "fill_id")), 1, 12)
    # an anti join would be pushed below the union, and the matches computed for either side
    left = both.join(done.withColumn("_done", F.lit(True)), ["kind", "fill_id"], "left").filter("_done is null")
    return left.select(ident.alias("break_id"), "fill_id", "kind", "severity")


def signed_notional(side: str = "side") -> Column:
    return F.when(F.col(side) == "buy", 1.0).otherwise(-1.0) * F.col("quantity") * F.col("price")


def pnl_reconciliation(internal: DataFrame, exchange: DataFrame, tol_pct: float = 0.01) -> DataFrame:
    """Signed notional by symbol on each side and whether they differ by more than the tolerance."""
    a = internal.groupBy("symbol").agg(F.sum(signed_notional()).alias("a"))
    b = exchange.groupBy("symbol").agg(F.sum(signed_notional()).alias("b"))
    out = a.join(b, "symbol", "full").select("symbol", F.coalesce("a", F.lit(0.0)).alias("internal"), F.coalesce("b", F.lit(0.0)).alias("exchange"))
    limit = F.greatest(F.abs("internal"), F.abs("exchange"), F.lit(1.0)) * tol_pct / 100
    return out.withColumn("differs", F.abs(F.col("internal") - F.col("exchange")) > limit)


def eod_report(internal: DataFrame, exchange: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: fills and notionals of both sides, matches, breaks by check, match rate (100 if there are none)."""
    side = lambda df, p: df.agg(F.count("*").alias(f"n_{p}"), F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)).alias(f"notional_{p}"))
    kinds = ("matched", "quantity", "price", "timestamp_drift")
    by = matches.agg(*(F.count(F.when(F.col("result") == k, 1)).alias(k) for k in kinds))
    out = side(internal, "internal").crossJoin(side(exchange, "exchange")).crossJoin(by)  # one row each
    rate = F.coalesce(100.0 * F.col("matched") / F.nullif(F.greatest("n_internal", "n_exchange"), F.lit(0)), F.lit(100.0))
    return out.withColumns({"difference": F.col("notional_internal") - F.col("notional_exchange"), "match_rate": rate})


def resolve_drift_breaks(breaks: DataFrame) -> DataFrame:
    hit = (F.col("status") == "open") & (F.col("result") == "timestamp_drift")
    return breaks.withColumn("status", F.when(hit, "resolved_auto").otherwise(F.col("status")))


def order_state(events: DataFrame) -> DataFrame:
    """Per order: latest event, filled quantity, average fill price, status (filled, partial, or the latest event)."""
    fill = F.col("event_type") == "fill"
    out = events.groupBy("order_id").agg(
        F.max_by("event_type", "sequence").alias("_last"), F.max("order_quantity").alias("quantity"), F.coalesce(F.sum(F.when(fill, F.col("quantity"))), F.lit(0.0)).alias("filled"),
        ratio(F.sum(F.when(fill, F.col("quantity") * F.col("price"))), F.sum(F.when(fill, F.col("quantity")))).alias("avg_price"), F.count(F.when(fill, 1)).alias("n_fills"),
    )
    status = F.when((F.col("n_fills") > 0) & (F.col("filled") >= F.col("quantity")), "filled").when((F.col("n_fills") > 0) & (F.col("_last") == "fill"), "partial").otherwise(F.col("_last"))
    return out.withColumn("status", status).drop("_last")


def next_position(state: tuple[float, float, float], trade: tuple) -> tuple[tuple, tuple]:
    """(position, average cost, realised pnl) after a trade (quantity, price, side); a flip through zero restarts the cost at its price."""
    pos, cost, pnl = state
    q, p, side = trade
    q = q if side == "buy" else -q
    if pos == 0 or pos * q > 0:
        cost = (abs(pos) * cost + abs(q) * p) / (abs(pos) + abs(q)) if pos + q else cost
        pos += q
    else:
        pnl += min(abs(q), abs(pos)) * (p - cost) * (1 if pos > 0 else -1)
        left = pos + q
        cost = 0.0 if left == 0 else p if left * pos < 0 else cost
        pos = left
    return (pos, cost, pnl), (pos, cost, pnl)


def position_state(trades: DataFrame, by=("account", "symbol"), order=("ts", "fill_id")) -> DataFrame:
    """Per trade: position, average cost, realised pnl; an ordered fold for each (account, symbol)."""
    keep = trades.select(*by, *order, "side", "quantity", "price")
    fields = "position double, avg_cost double, realized double"
    out = ordered_fold(keep, list(by), list(order), lambda: (0.0, 0.0, 0.0), next_position, ["quantity", "price", "side"], fields)
    return out.drop("side", "quantity", "price")


def position_quantity(trades: DataFrame, by=("account", "symbol"), order=("ts", "fill_id")) -> DataFrame:
    """Adds the position after each trade: a running sum, for uses that need no cost."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return trades.withColumn("position", F.sum(signed).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def exposure_summary(positions: DataFrame, equity: float, max_leverage: float = 2.0, max_share: float = 0.25, by: str = "account") -> DataFrame:
    """Per entity: gross, net, leverage, largest share of gross, and limit breaches, from (entity, symbol, quantity, price)."""
    value = F.col("quantity") * F.col("price")
    each = positions.groupBy(by, "symbol").agg(F.sum(value).alias("_v"))
    out = each.groupBy(by).agg(F.sum(F.abs("_v")).alias("gross"), F.sum("_v").alias("net"), ratio(F.max(F.abs("_v")), F.sum(F.abs("_v"))).alias("largest_share"))
    return out.withColumn("leverage", F.col("gross") / equity).withColumns({"over_leverage": F.col("leverage") > max_leverage, "over_share": F.col("largest_share") > max_share})


def exposure_rollup(fills: DataFrame) -> DataFrame:
    """Signed notional at firm, account and (account, strategy) level."""
    out = fills.rollup("account", "strategy").agg(F.sum(signed_notional()).alias("notional"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("int"))


def order_lifecycle(messages: DataFrame) -> DataFrame:
    """Per order reference: shares added, executed, cancelled, deleted, the replacing reference, what remains, lifetime in seconds."""
    total = lambda k: F.coalesce(F.sum(F.when(F.col("msg_type").isin(*k), F.col("shares"))), F.lit(0.0))
    out = messages.groupBy("order_ref").agg(
        total("AF").alias("added"), total("EC").alias("executed"), total("X").alias("cancelled"), (F.count(F.when(F.col("msg_type") == "D", 1)) > 0).alias("deleted"),
        F.max(F.when(F.col("msg_type") == "U", F.col("new_ref"))).alias("replaced_by"), ((F.max(micros("ts")) - F.min(micros("ts"))) / 1e6).alias("lifetime_s"),
    )
    left = F.when(F.col("deleted") | F.col("replaced_by").isNotNull(), 0.0).otherwise(F.col("added") - F.col("executed") - F.col("cancelled"))
    return out.withColumn("remaining", left)


def top_levels(orders: DataFrame, side: str, k: int, by: str = "symbol") -> DataFrame:
    """The best k price levels with their total size: bids from the top, asks from the bottom."""
    level = orders.filter(F.col("side") == side).groupBy(by, "price").agg(F.sum("size").alias("size"))
    w = Window.partitionBy(by).orderBy(F.desc("price") if side == "B" else F.asc("price"))
    return level.withColumn("level", F.row_number().over(w)).filter(F.col("level") <= k)


def read_events(events: DataFrame, aggregate: str | None = None, event_type: str | None = None, since: int | None = None) -> DataFrame:
    """Events of an aggregate or type after a sequence, in sequence order."""
    for c, v in (("aggregate_id", aggregate), ("event_type", event_type)):
        events = events if v is None else events.filter(F.col(c) == v)
    return (events if since is None else events.filter(F.col("sequence") > since)).orderBy("sequence")


def ordered_checksum(events: DataFrame, cols: list[str]) -> DataFrame:
    """One row: count and the sum of 60-bit prefixes of SHA-256 over sequence and columns, whatever the order of work."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in cols)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return events.agg(F.count("*").alias("n"), F.sum(digest).cast("string").alias("checksum"))


def latency_stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Least, largest and mean value, median, 99th percentile and count of each (large) group."""
    ends = df.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("avg"), F.count(col).alias("n"))
    return ends.join(exact_quantiles(df, col, {"p50": 0.5, "p99": 0.99}, by), by, "left").select(*by, "min", "max", "avg", "p50", "p99", "n")


def message_stats(messages: DataFrame) -> DataFrame:
    """Number of messages of each type."""
    return messages.groupBy("msg_type").agg(F.count("*").alias("n"))


def sequence_gaps(messages: DataFrame, by: str = "session", seq: str = "seq") -> DataFrame:
    """Missing sequence numbers of each session: first and last of each gap."""
    last = F.lag(seq).over(Window.partitionBy(by).orderBy(seq))
    return messages.select(by, seq).distinct().withColumn("_l", last).filter(F.col(seq) > F.col("_l") + 1).select(by, (F.col("_l") + 1).alias("gap_begin"), (F.col(seq) - 1).alias("gap_end"))
