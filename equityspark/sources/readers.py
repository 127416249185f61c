"""Scans and source-side normalisation (ids A1-A4, A7-A9, A13, A15, B1-B4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equityspark.functions.core import series, attach_row

# Bar intervals and the look-back of each named period in days.
INTERVALS = ["1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo"]
PERIOD_DAYS = {
    "1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825,
}
PERIOD_DEFAULT_DAYS = 3650
COLLECTOR_PERIOD_DAYS = {"1y": 365, "2y": 730, "5y": 1825, "10y": 3650}
COLLECTOR_DEFAULT_DAYS = 7300

BAR_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType()), T.StructField("adj_close", T.DoubleType())]
)


def scan_prices(df: DataFrame, tickers: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Rows of the given tickers.

    On a table stored by ``write_by_ticker`` (with the same ``buckets``) the folders of other
    buckets are not read and the ticker predicate reaches the files, which are sorted by ticker.
    On a computed ticker column the predicate is evaluated per row.
    """
    if not tickers:
        return df
    rows = df.where(F.col("ticker").isin(tickers))
    if "ticker_bucket" in df.columns:
        own = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in tickers]
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("ticker_bucket") == b for b in own]))
    return rows


def bucket_start(ts: Column, interval: str) -> Column:
    """Start of the bar that ``ts`` falls in."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}")
    if interval.endswith("mo"):
        months = int(interval[:-2])
        first = F.trunc(ts, "month")
        return F.add_months(first, -F.pmod(F.month(first) - 1, F.lit(months)))
    if interval.endswith("wk"):
        return F.trunc(ts, "week")
    if interval.endswith("d"):
        days = int(interval[:-1])
        d = F.to_date(ts)
        return F.date_sub(d, F.pmod(F.unix_date(d), F.lit(days))) if days > 1 else d
    minutes = int(interval[:-1]) * (60 if interval.endswith("h") else 1)
    seconds = F.unix_timestamp(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60)))


def packed_order(parts: list[tuple[Column, int]]) -> Column:
    """One decimal that orders like the whole numbers ``parts`` (column, decimal digits), first part highest.

    A decimal has a fixed place in an aggregation buffer, a struct has not: with it ``min_by``
    and ``max_by`` run as a hash aggregate. At most 38 digits; a number that does not fit its
    digits or is negative is an error, never a wrong order.
    """
    if sum(d for _, d in parts) > 38 or any(d > 18 for _, d in parts):
        raise ValueError("at most 38 digits in all and 18 in one part")
    words: list[tuple[Column, int]] = []
    for x, digits in parts:
        x = x.cast("long")
        fits = F.when((x >= 0) & (x < 10**digits), x).when(x.isNotNull(), F.raise_error(F.lit(f"order key beyond {digits} digits")).cast("long"))
        if words and words[-1][1] + digits <= 18:
            high, used = words.pop()
            words.append((high * 10**digits + fits, used + digits))
        else:
            words.append((fits, digits))
    out = words[0][0].cast("decimal(38,0)")
    for x, digits in words[1:]:
        out = (out * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)") + x.cast("decimal(19,0)")
        out = out.cast("decimal(38,0)")
    return out


def _order(df: DataFrame, time_col: str, seq: str | list[tuple[str, int]]) -> Column:
    kinds = dict(df.dtypes)
    if isinstance(seq, str) and kinds[seq] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(F.col(time_col), F.col(seq))
    day, micros = F.unix_date(F.to_date(time_col)) + 1_000_000, F.unix_micros(F.col(time_col).cast("timestamp"))
    clock = [(day, 7)] if kinds[time_col] == "date" else [(day, 7), (F.pmod(micros, F.lit(86_400_000_000)), 11)]
    rest = [(F.col(c), d) for c, d in seq] if isinstance(seq, list) else [(F.col(seq), 18)]
    return packed_order([*clock, *rest])


def resample_ohlcv(
    df: DataFrame, keys: list[str], time_col: str, price: str, qty: str, seq: str | list[tuple[str, int]], interval: str = "1d"
) -> DataFrame:
    """Ticks to OHLCV bars. ``seq`` orders ticks inside an instant and must be unique there (or tie
    only between identical ticks): a column, or several whole-number columns with their digits.

    open/close are ``min_by``/``max_by``: they combine on the map side, so a ticker that
    holds a third of all ticks still shuffles one row per bar and map task. Whole-number
    sequences are packed with the time into one decimal, which keeps this a hash aggregate;
    a sequence of another type makes each task sort its ticks first.
    """
    order = _order(df, time_col, seq)
    pre = df.select(*keys, bucket_start(F.col(time_col), interval).alias("_bar"), F.col(price).alias("_price"), F.col(qty).alias("_qty"), order.alias("_order"))
    return (
        pre.groupBy(*keys, F.col("_bar").alias("date"))
        .agg(
            F.min_by("_price", "_order").alias("open"),
            F.max("_price").alias("high"),
            F.min("_price").alias("low"),
            F.max_by("_price", "_order").alias("close"),
            F.sum("_qty").alias("volume"),
        )
    )


def resample_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Bars to coarser bars."""
    pre = bars.withColumn("_bar", bucket_start(F.col("date"), interval))
    return pre.groupBy("ticker", F.col("_bar").alias("date")).agg(
        F.min_by("open", F.col("date")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("date")).alias("close"),
        F.sum("volume").alias("volume"),
    )


def normalize_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Lower-case, underscore names, then explicit renames."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return out.withColumnsRenamed(rename) if rename else out


def normalize_vendor_bars(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor aggregate rows (o,h,l,c,v and epoch-ms t) to the bar schema."""
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "T": "ticker"}
    out = df.toDF(*[names.get(c, c) for c in df.columns])  # exact case: "t" is the time, "T" the ticker
    if "t" in out.columns:
        out = out.withColumn("date", F.to_date(F.timestamp_millis(F.col("t")))).drop("t")
    out = normalize_columns(out)
    if ticker is not None and "ticker" not in out.columns:
        out = out.withColumn("ticker", F.lit(ticker))
    return out


def with_fallback(primary: DataFrame, secondary: DataFrame, min_rows: int = 200) -> DataFrame:
    """Per ticker the primary feed if it has enough rows, else the secondary, else nothing.

    The row counts are aggregated first (one row per ticker and feed) and joined back,
    so no feed is ever gathered whole on one task.
    """
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1)))
    chosen = (
        both.groupBy("ticker", "_src").agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_rows)
        .groupBy("ticker").agg(F.min("_src").alias("_src"))
    )
    return both.join(chosen, ["ticker", "_src"], "left_semi").drop("_src")


FINANCIAL_GROUPS = {
    "valuation": [
        "market_cap", "enterprise_value", "pe_ratio", "forward_pe", "peg_ratio", "price_to_book",
        "price_to_sales", "ev_to_revenue", "ev_to_ebitda",
    ],
    "profitability": ["profit_margin", "operating_margin", "gross_margin", "roe", "roa"],
    "growth": ["revenue_growth", "earnings_growth", "revenue", "earnings"],
    "financial_health": [
        "total_cash", "total_debt", "debt_to_equity", "current_ratio", "quick_ratio", "free_cash_flow",
    ],
    "dividend": ["dividend_rate", "dividend_yield", "payout_ratio"],
    "analyst_metrics": [
        "target_high", "target_low", "target_mean", "target_median", "recommendation", "num_analyst_opinions",
    ],
}


def financials_schema() -> T.StructType:
    def kind(name: str):
        return T.StringType() if name == "recommendation" else T.DoubleType()

    groups = [
        T.StructField(g, T.StructType([T.StructField(c, kind(c)) for c in cols]))
        for g, cols in FINANCIAL_GROUPS.items()
    ]
    return T.StructType([T.StructField("ticker", T.StringType()), *groups])


def flatten_financials(df: DataFrame, body: str | None = None) -> DataFrame:
    """Nested record (struct columns, or JSON text in ``body``) to one flat row per ticker."""
    if body is not None:
        df = df.select(F.from_json(body, financials_schema()).alias("_f")).select("_f.*")
    cols = [F.col(f"{g}.{c}").alias(c) for g, names in FINANCIAL_GROUPS.items() for c in names]
    return df.select(F.upper("ticker").alias("ticker"), *cols)


NEWS_SCHEMA = (
    "title string, publisher string, link string, providerPublishTime long, type string, "
    "thumbnail struct<resolutions: array<struct<url: string>>>"
)


def project_news(df: DataFrame, body: str, ticker: str = "ticker", order: str = "seq", limit: int = 10) -> DataFrame:
    """Vendor news JSON to flat articles, the first ``limit`` per ticker in feed order."""
    a = df.select(F.col(ticker).alias("ticker"), F.col(order).alias("seq"), F.from_json(body, NEWS_SCHEMA).alias("a"))
    w = Window.partitionBy("ticker").orderBy("seq")
    epoch = F.nullif(F.col("a.providerPublishTime"), F.lit(0))
    return (
        a.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
        .select(
            "ticker",
            F.coalesce("a.title", F.lit("")).alias("title"),
            F.coalesce("a.publisher", F.lit("")).alias("publisher"),
            F.coalesce("a.link", F.lit("")).alias("link"),
            F.timestamp_seconds(epoch).alias("published"),
            F.coalesce("a.type", F.lit("")).alias("type"),
            F.get(F.col("a.thumbnail.resolutions"), 0).getField("url").alias("thumbnail"),
        )
    )


def earnings_calendar(history: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Historic dates plus the next announced date per ticker, flagged."""
    nxt = upcoming.groupBy("ticker").agg(F.min("date").alias("date")).withColumn("upcoming", F.lit(True))
    return (
        history.withColumn("upcoming", F.lit(False))
        .unionByName(nxt, allowMissingColumns=True)
        .withColumn("type", F.lit("earnings"))
    )


def load_universes(spark: SparkSession, path: str) -> DataFrame:
    """A folder of universe JSON files to (universe, sector, ticker); the file stem is the name."""
    schema = "name string, description string, last_updated string, tickers array<string>, sectors map<string,array<string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("_file", r"\.json$", "")
    sectors = raw.select(stem.alias("universe"), F.explode("sectors").alias("sector", "_t")).select(
        "universe", "sector", F.explode("_t").alias("ticker")
    )
    listed = raw.select(stem.alias("universe"), F.explode("tickers").alias("ticker"))
    loose = listed.join(sectors, ["universe", "ticker"], "left_anti").select(
        "universe", F.lit(None).cast("string").alias("sector"), "ticker"
    )
    return sectors.unionByName(loose)


def project_company(df: DataFrame) -> DataFrame:
    """Company record with fallbacks; rows without a symbol are rejected."""
    have = set(df.columns)

    def c(*names: str, default=None) -> Column:
        cols = [F.col(n) for n in names if n in have]
        if default is not None:
            cols.append(F.lit(default))
        return F.coalesce(*cols) if cols else F.lit(None)

    return df.where(F.col("symbol").isNotNull()).select(
        "symbol",
        c("longName", "shortName", default="N/A").alias("name"),
        c("sector", default="N/A").alias("sector"),
        c("industry", default="N/A").alias("industry"),
        c("marketCap").cast("double").alias("market_cap"),
        c("currentPrice", "regularMarketPrice").cast("double").alias("current_price"),
        c("currency", default="USD").alias("currency"),
        c("exchange", default="N/A").alias("exchange"),
        c("longBusinessSummary", default="N/A").alias("description"),
    )


def period_start(end: Column, period: str, collector: bool = False) -> Column:
    """First calendar day of a named period ending at ``end``."""
    if collector:
        return F.date_sub(end, COLLECTOR_PERIOD_DAYS.get(period, COLLECTOR_DEFAULT_DAYS))
    return F.date_sub(end, PERIOD_DAYS.get(period, PERIOD_DEFAULT_DAYS))


def within_period(bars: DataFrame, period: str, collector: bool = False) -> DataFrame:
    """Rows inside the period that ends at the newest date of the data.

    The end date is a one-row aggregate, broadcast because it is one row.
    """
    end = bars.agg(F.max("date").alias("_end"))
    joined = attach_row(bars, end)
    return joined.where(F.col("date") >= period_start(F.col("_end"), period, collector)).drop("_end")


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def warmup_range(df: DataFrame, start: str, end: str, days: int = 100) -> DataFrame:
    """Range widened backwards so that trailing indicators are filled at ``start``."""
    return df.where(
        (F.col("date") >= F.date_sub(F.lit(start).cast("date"), days)) & (F.col("date") <= F.lit(end).cast("date"))
    )


def min_history(df: DataFrame, n: int) -> DataFrame:
    """Only tickers with at least ``n`` rows."""
    w = Window.partitionBy("ticker")
    return df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= n).drop("_n")


def numbered(df: DataFrame) -> DataFrame:
    """Row position (0-based) and length of each series."""
    return df.withColumns(
        {"pos": F.row_number().over(series()) - 1, "n_rows": F.count("*").over(Window.partitionBy("ticker"))}
    )
