"""Text and alternative-data signals, and scalar helpers of prices, costs and payloads."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import micros, ratio


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sentiment_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(p - n) / (p + n) over the distinct words (runs of a-z, 0-9 and _) of the lower-cased text, 0 without any."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))
    hits = lambda w, listed: F.size(F.array_intersect(w, F.array(*map(F.lit, listed))))
    counted = _bound(words, lambda w: F.struct(hits(w, positive).alias("p"), hits(w, negative).alias("n")))
    score = _bound(counted, lambda c: F.coalesce((c.p - c.n) / F.nullif((c.p + c.n).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.when(text.isNotNull(), score)


def sentiment_label(score: Column, at: float = 0.3) -> Column:
    return F.when(score > at, "positive").when(score < -at, "negative").otherwise("neutral")


def record_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 12)


def tag_symbols(articles: DataFrame, symbols: DataFrame, text: str = "text", key: str = "article_id") -> DataFrame:
    """(article, symbol) for each symbol in the lower-cased text; an article with none gets the first symbol.

    symbols (symbol, needle, rank) is a short given list.
    """
    small = F.broadcast(symbols)
    hit = articles.join(small, F.contains(F.lower(articles[text]), F.lower(small["needle"])))
    first = symbols.orderBy("rank").limit(1).select(F.col("symbol").alias("symbol"))
    rest = articles.join(hit.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(first))  # one row
    return hit.select(key, "symbol").unionByName(rest.select(key, "symbol"))


def composite_signal(records: DataFrame, as_of: str, half_life_h: float = 24.0, by: str = "symbol") -> DataFrame:
    """Sum of value x confidence x decay over the sum of confidence x decay; decay exp(-0.693 age / half-life)."""
    age = (micros(F.to_timestamp_ntz(F.lit(as_of))) - micros("ts")) / 3.6e9
    weight = F.col("confidence") * F.exp(-0.693 * age / half_life_h)
    return records.groupBy(by).agg(ratio(F.sum(F.col("value") * weight), F.sum(weight)).alias("signal"))


def alt_features(records: DataFrame, names: list[str], by: str = "symbol") -> DataFrame:
    """One row per symbol: alt_<source>_<type> and its confidence, the last record winning; names are the source_type pairs."""
    tagged = records.withColumn("_n", F.concat_ws("_", "source", "data_type"))
    last = tagged.groupBy(by, "_n").agg(F.max_by(F.struct("value", "confidence"), F.struct("ts", "seq")).alias("v"))
    aggs = [a for n in names for a in (F.max(F.when(F.col("_n") == n, F.col("v.value"))).alias(f"alt_{n}"), F.max(F.when(F.col("_n") == n, F.col("v.confidence"))).alias(f"alt_{n}_confidence"))]
    return last.groupBy(by).agg(*aggs)


def unusual_options(flow: DataFrame, threshold: float = 3.0, premium: float = 50_000.0) -> DataFrame:
    """Rows whose volume / open interest (0 without any) and premium pass, or that are sweeps or blocks; with ratio and confidence."""
    r = F.coalesce(ratio(F.col("volume"), F.col("open_interest")), F.lit(0.0))
    out = flow.withColumns({"vol_oi": r, "confidence": F.least(r / threshold, F.lit(1.0))})
    return out.filter(((F.col("vol_oi") > threshold) & (F.col("premium") > premium)) | F.col("is_sweep") | F.col("is_block"))


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]], ops=("mul", "add", "sub", "div")) -> DataFrame:
    make = {"mul": lambda a, b: a * b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "div": ratio}
    return df.withColumns({f"{a}_{op}_{b}": make[op](F.col(a), F.col(b)) for a, b in pairs for op in ops})


def polynomial_features(df: DataFrame, cols: list[str], degree: int = 2) -> DataFrame:
    """All monomials of degree 1..n (no constant); null counts as 0."""
    new = {}
    for k in range(2, degree + 1):
        for term in combinations_with_replacement(cols, k):
            out = F.lit(1.0)
            for c in term:
                out = out * F.coalesce(F.col(c), F.lit(0.0))
            new["*".join(term)] = out
    return df.withColumns(new)


def impact_price(price: Column, signed_qty: Column, volume: Column, model: str = "sqrt", coef: float = 0.1, power: float = 0.6) -> Column:
    """Price moved by linear, square-root or power-law impact of the share of volume."""
    share = F.abs(ratio(signed_qty, volume))
    size = {"linear": share, "sqrt": F.sqrt(share), "power": F.pow(share, F.lit(power))}[model]
    return price * (1 + F.signum(signed_qty) * coef * size)


def sqrt_impact(orders: DataFrame, alpha: float = 0.5) -> DataFrame:
    """impact = alpha sigma / sqrt(252) sqrt(Q / V); cost = (impact + half the relative spread) x notional."""
    impact = alpha * F.col("sigma") / (252**0.5) * F.sqrt(ratio(F.col("quantity"), F.col("volume")))
    half = ratio(F.col("spread"), 2 * F.col("price"))
    return orders.withColumns({"impact": impact, "half_spread": half, "cost": (impact + half) * F.col("quantity") * F.col("price")})


def almgren_chriss(orders: DataFrame, n: int = 10, horizon: float = 1.0, kappa: float = 0.6, eta: float = 1e-6, gamma: float = 1e-7) -> DataFrame:
    """Holdings x_k = X sinh(k (T - t_k)) / sinh(k T), permanent and temporary cost and variance of each order."""
    tau = horizon / n
    path = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.col("quantity") * F.sinh(kappa * (F.lit(horizon) - k * tau)) / F.sinh(F.lit(kappa * horizon)))
    out = orders.withColumn("holdings", path)
    sold = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.element_at("holdings", k) - F.element_at("holdings", k + 1))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return out.withColumns(
        {"permanent": 0.5 * gamma * F.col("quantity") ** 2, "temporary": square(sold) * (eta / tau), "variance": F.pow("sigma", 2) * tau * (square(F.col("holdings")) - F.pow("quantity", 2))}
    )


def maker_quotes(df: DataFrame, gamma: float = 0.1, min_bps: float = 5.0, kappa: float = 1.5, horizon: float = 1.0) -> DataFrame:
    """Reservation price mid - q gamma sigma^2 T and quotes around it, spread at least min_bps of mid."""
    var = F.pow("sigma", 2) * horizon
    reserve = F.col("mid") - F.col("inventory") * gamma * var
    spread = F.greatest(gamma * var + (2 / gamma) * F.ln(F.lit(1 + gamma / kappa)), F.col("mid") * min_bps / 1e4)
    return df.withColumns({"reservation": reserve, "bid_quote": F.round(reserve - spread / 2, 2), "ask_quote": F.round(reserve + spread / 2, 2)})


def fill_costs(fills: DataFrame, rate: float = 0.0005) -> DataFrame:
    """Notional, commission, slippage against the reference price (positive is a cost) and the total."""
    notional = F.col("quantity") * F.col("price")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    slip = sign * (F.col("price") - F.col("ref_price")) * F.col("quantity")
    return fills.withColumns({"notional": notional, "commission": notional * rate, "slippage": slip, "total_cost": notional * rate + slip})


def decode_payload(df: DataFrame, schema: str, col: str = "payload") -> DataFrame:
    """JSON payload columns; a malformed one gives nulls."""
    return df.withColumn("_p", F.from_json(col, schema)).select("*", "_p.*").drop("_p")


def payload_variant(df: DataFrame, col: str = "payload", out: str = "payload_v") -> DataFrame:
    """Adds the JSON text as a variant, which keeps any shape; a malformed one gives null."""
    return df.withColumn(out, F.try_parse_json(col))


def payload_value(path: str, kind: str, col: str = "payload_v") -> Column:
    """The value at a path ($.a.b[0]) of a variant; null if it is absent or not of the kind."""
    return F.try_variant_get(col, path, kind)


def payload_schema(df: DataFrame, col: str = "payload_v") -> str:
    """The schema that holds all variants of the column, in DDL (one aggregate over all rows), VOID if all are null; from_json and decode_payload take it."""
    # OBJECT<a: BIGINT> is a struct in DDL
    return df.agg(F.schema_of_variant_agg(col).alias("s")).first()["s"].replace("OBJECT<", "STRUCT<")


def payload_entries(df: DataFrame, keys: list[str], col: str = "payload_v") -> DataFrame:
    """(keys, pos, key, value): one row for each member of an object or array, its value as JSON text; rows without members give none."""
    entries = df.sparkSession.tvf.variant_explode(F.col(col).outer())
    return df.lateralJoin(entries).select(*keys, "pos", "key", F.to_json("value").alias("value"))


def date_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds us (microseconds since the epoch), weekday (Monday 0), tod (time of day) and year_month of a timestamp."""
    t = F.col(ts).cast("timestamp")
    return df.withColumns({"us": micros(ts), "weekday": F.weekday(t).cast("long"), "tod": F.date_format(t, "HH:mm:ss"), "year_month": F.date_format(t, "yyyy-MM")})


def from_nanoseconds(ns: Column) -> Column:
    """The timestamp of nanoseconds since the epoch, to the microsecond below."""
    return F.timestamp_micros(F.floor(ns / 1000))
