"""Reading and writing market data: CSV, Parquet, partitioned stores, JDBC, registered SQL, synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import micros


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with a given schema (never inferred)."""
    return spark.read.schema(schema).options(sep=sep, header=header, timestampNTZFormat=MICROS).csv(path)


def read_ticks(spark: SparkSession, path: str, symbol=None, start=None, end=None) -> DataFrame:
    """A store partitioned by symbol, cut by symbol and closed time range at the scan; of one symbol only its folder is listed."""
    fs, at = _fs(spark, path)
    own = f"{path}/symbol={symbol}"
    if isinstance(symbol, int) and fs.exists(at(own)):
        df = spark.read.option("basePath", path).parquet(own)
    else:
        df = spark.read.parquet(path)
        if symbol is not None:
            df = df.filter(F.col("symbol") == symbol)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast(df.schema["ts"].dataType))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast(df.schema["ts"].dataType))
    return df


def register_and_query(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", compression if fmt == "parquet" else "none")
    writer.parquet(path) if fmt == "parquet" else writer.options(header=True, timestampNTZFormat=MICROS).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "symbol", mode: str = "overwrite", files: int = 1, heavy: int = 100_000) -> None:
    """Hive layout with zstd; `files` deals a partition value of over `heavy` rows to several tasks and files, others have one.

    The work is in the number of files, not in their bytes, so that tasks have a set number (by bytes they would be merged into one), and
    they put their files in place themselves (committer 2), as the driver would rename one folder after the other.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.lit(0)
    if files > 1:
        many = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy)
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(files))
        df = df.join(many, F.col(by).eqNullSafe(F.col("_by")), "left")
        salt = F.when(F.col("_n").isNotNull(), spread).otherwise(0)
    out = df.repartition(tasks, by, salt).drop("_by", "_n").write.mode(mode).option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.partitionBy(by).parquet(path)


def write_market_store(df: DataFrame, path: str, mode: str = "append") -> None:
    """Month partitions, rows in (symbol, ts) order within range-dealt tasks."""
    df = df.withColumn("year_month", F.date_format("ts", "yyyy-MM"))
    df.repartitionByRange("year_month", "symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode(mode).option("compression", "zstd").partitionBy("year_month").parquet(path)


def apply_retention(df: DataFrame, days: int, as_of: str) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def store_months(spark: SparkSession, path: str) -> list[str]:
    """The month folders of a store, oldest first."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory()]
    return sorted(n.split("=")[1] for n in names if n.startswith("year_month="))


def recover_store(spark: SparkSession, path: str) -> None:
    """Ends a retention that was cut off: a month whose folder is away gets its kept rows if they were written whole, else its old ones."""
    fs, at = _fs(spark, path)
    for name in [f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory()]:
        if name.startswith("_retired-"):
            month = name.removeprefix("_retired-")
            place, kept = at(f"{path}/year_month={month}"), at(f"{path}/_kept-{month}")
            if not fs.exists(place):
                fs.rename(kept if fs.exists(at(f"{path}/_kept-{month}/_SUCCESS")) else at(f"{path}/{name}"), place)
            fs.delete(at(f"{path}/{name}"), True)
    for f in fs.listStatus(at(path)):
        if f.getPath().getName().startswith("_kept-"):
            fs.delete(f.getPath(), True)


def retain(spark: SparkSession, path: str, days: int, as_of: str) -> None:
    """Removes the rows of a market store that are over `days` older than as_of.

    Months before the boundary go as whole folders, later ones are not touched; the boundary month alone is read, and its rows from
    the limit on are written beside it and put in its place by renames.  A run that was cut off at any step is ended by the next
    one (or by recover_store) and loses no row that has to stay.
    """
    recover_store(spark, path)
    fs, at = _fs(spark, path)
    limit = spark.range(1).select((F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")).alias("t")).first()["t"]
    boundary = f"{limit:%Y-%m}"
    for month in store_months(spark, path):
        if month < boundary:
            fs.delete(at(f"{path}/year_month={month}"), True)
    if boundary in store_months(spark, path):
        place, kept, retired = (f"{path}/{n}{boundary}" for n in ("year_month=", "_kept-", "_retired-"))
        rows = spark.read.parquet(place)
        rows.filter(F.col("ts") >= F.lit(str(limit)).cast("timestamp_ntz")).sortWithinPartitions("symbol", "ts").write.option("compression", "zstd").parquet(kept)
        fs.rename(at(place), at(retired))
        fs.rename(at(kept), at(place))
        fs.delete(at(retired), True)


def query_store(store: DataFrame, symbols: list, start: str, end: str, **equal) -> DataFrame:
    """Closed time range of some symbols in time order; `equal` filters other columns (venue, granularity)."""
    df = store.filter(F.col("symbol").isin(*symbols) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy("ts", "symbol")


def query_book(store: DataFrame, symbols: list, start: str, end: str, depth: int | None = None) -> DataFrame:
    """As query_store, the book arrays cut to the depth."""
    df = query_store(store, symbols, start, end)
    if depth is None:
        return df
    return df.withColumns({c: F.slice(c, 1, depth) for c in ("bid_prices", "bid_sizes", "ask_prices", "ask_sizes")})


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str, low, high, parts: int, **options) -> DataFrame:
    """Parallel range reads of a warehouse table (the driver jar is the user's)."""
    return spark.read.jdbc(url, table, column=partition_col, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def _uniform(*parts) -> F.Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _normal(*parts) -> F.Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.ln(_uniform(*parts, F.lit("a")))) * F.cos(2 * 3.141592653589793 * _uniform(*parts, F.lit("b")))


def synthetic_ticks(spark: SparkSession, n_symbols: int, n_ticks: int, seed: int = 0, tick: float = 0.01, sigma: float = 0.001) -> DataFrame:
    """Log-normal walks rounded to the tick size, log-normal volumes, spreads of 1 to 3 ticks (0.6, 0.3, 0.1); the same for a seed."""
    ids = spark.range(n_symbols).select(F.col("id").alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(n_ticks - 1))).alias("seq"))
    s = F.lit(seed)
    ids = ids.withColumn("_z", _normal("symbol", "seq", s))
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    price = F.round(100 * F.exp(sigma * F.sum("_z").over(w)) / tick) * tick
    u = _uniform("symbol", "seq", s, F.lit("spread"))
    spread = tick * F.when(u < 0.6, 1).when(u < 0.9, 2).otherwise(3)
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("seq") * 100_000).cast("timestamp_ntz")
    out = ids.withColumns({"price": price, "ts": ts, "volume": F.greatest(F.round(F.exp(4 + _normal("symbol", "seq", s, F.lit("v")))), F.lit(1.0))})
    side = F.when(_uniform("symbol", "seq", s, F.lit("side")) < 0.5, "B").otherwise("A")
    return out.withColumns({"bid": F.col("price") - spread / 2, "ask": F.col("price") + spread / 2, "side": side}).drop("_z")


def synthetic_books(ticks: DataFrame, levels: int = 10, tick: float = 0.01) -> DataFrame:
    """Books with linear levels around the ticks' quotes."""
    k = F.sequence(F.lit(0), F.lit(levels - 1))
    size = F.transform(k, lambda i: F.col("volume") * (i + 1))
    return ticks.select("symbol", "ts", "seq", F.transform(k, lambda i: F.col("bid") - tick * i).alias("bid_prices"), size.alias("bid_sizes"), F.transform(k, lambda i: F.col("ask") + tick * i).alias("ask_prices"), size.alias("ask_sizes"))


def to_nanoseconds(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_ns", micros("ts") * 1000)
