"""Exchange files: price-report XML, RSS feeds, bars and surfaces in parquet or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions import text as X
from volpanel.operators.keep import keep_one
from volpanel.operators.panel import nan_to_null
from volpanel.operators.surface import wide_to_long
from volpanel.session import stage
from volpanel.sources.documents import read_documents

# Element names and the ticker pattern of the price report.
FUTURE_TICKER = r"^DOL[A-Z][0-9]{2}$"
_AMOUNT = "struct<_VALUE:double,_Ccy:string>"
PRICE_REPORT = (
    "TradDt struct<Dt:date>, SctyId struct<TckrSymb:string>, "
    f"FinInstrmAttrbts struct<AdjstdQt:{_AMOUNT},FrstPric:{_AMOUNT},LastPric:{_AMOUNT},MinPric:{_AMOUNT},"
    f"MaxPric:{_AMOUNT},OpnIntrst:double,TradQty:double>"
)
PRICE_REPORT_COLUMNS = PRICE_REPORT.replace(" struct<", ": struct<")
RSS_ITEM = "title string, link string, pubDate string, description string"
RSS_COLUMNS = RSS_ITEM.replace(" string", ": string")


#: The folder of a file; a day's package is unpacked into one of its own.
FOLDER = r"^(.*)/[^/]*$"


def newest_snapshots(spark: SparkSession, path: str | list[str], package: Column | None = None) -> DataFrame:
    """(package, path, snapshots): the last file by name of every package, and how many it has, from the listing of files; nothing is opened.

    ``package`` is an expression of the column ``path``, by default the file's folder.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    named = listing.withColumn("package", F.regexp_extract("path", FOLDER, 1) if package is None else package)
    return named.groupBy("package").agg(F.max("path").alias("path"), F.count(F.lit(1)).alias("snapshots"))


def read_price_reports(spark: SparkSession, path: str | list[str], package: Column | None = None, every: bool = False) -> DataFrame:
    """One row per instrument of unpacked report files, one task per file; the snapshot is the file name.

    A day comes as several progressive snapshots of some hundred megabytes each. Only the last one of each package (see ``newest_snapshots``) is
    opened, unless ``every`` asks for all. The driver sees one path per package, as it does when it lists the files.
    """
    if not every:
        path = sorted(row.path for row in newest_snapshots(spark, path, package).select("path").collect())
        if not path:
            return spark.createDataFrame([], f"{PRICE_REPORT_COLUMNS}, snapshot string")
    reader = spark.read.format("xml").option("rowTag", "PricRpt").option("mode", "FAILFAST").option("recursiveFileLookup", True)
    raw = reader.schema(PRICE_REPORT).load(path)
    return raw.withColumn("snapshot", F.col("_metadata.file_name"))


def parse_price_reports(docs: DataFrame) -> DataFrame:
    """The same rows from report texts (doc, snapshot) held in a table."""
    schema = f"PricRpt array<struct<{PRICE_REPORT_COLUMNS}>>"
    report = F.from_xml("doc", schema, {"mode": "FAILFAST"})
    return docs.select("snapshot", F.explode(report["PricRpt"]).alias("_i")).select("_i.*", "snapshot")


def futures_contracts(reports: DataFrame, ticker: str = FUTURE_TICKER) -> DataFrame:
    """(date, ticker, settlement, open, last, low, high, open_interest, trades) of futures with a settlement.

    A day is delivered as several progressive snapshots; rows of its last one (by file name) count.
    """
    a = "FinInstrmAttrbts"
    is_future = F.col("SctyId.TckrSymb").rlike(ticker) & F.col(f"{a}.AdjstdQt._VALUE").isNotNull()
    row = F.struct(
        F.col("SctyId.TckrSymb").alias("ticker"),
        F.col(f"{a}.AdjstdQt._VALUE").alias("settlement"), F.col(f"{a}.FrstPric._VALUE").alias("open"),
        F.col(f"{a}.LastPric._VALUE").alias("last"), F.col(f"{a}.MinPric._VALUE").alias("low"),
        F.col(f"{a}.MaxPric._VALUE").alias("high"), F.col(f"{a}.OpnIntrst").alias("open_interest"),
        F.col(f"{a}.TradQty").alias("trades"),
    )
    # The large reports are parsed once. Instruments that are no futures only name the snapshot, as one row for all of them.
    parsed = reports.select(F.col("TradDt.Dt").alias("date"), "snapshot", F.when(is_future, row).alias("_r")).distinct()
    slim = stage(parsed, "price-rows")
    newest = slim.groupBy("date").agg(F.max("snapshot").alias("_newest")).withColumnRenamed("date", "_date")
    last = F.col("date").eqNullSafe(F.col("_date")) & (F.col("snapshot") == F.col("_newest"))
    return nan_to_null(slim.filter(F.col("_r").isNotNull()).join(newest, last).select("date", "_r.*"))


def weekdays(df: DataFrame, time: str = "date") -> DataFrame:
    return df.filter(F.weekday(time) < 5)


def read_rss(spark: SparkSession, path: str | list[str], bundled: bool = False) -> DataFrame:
    """One row per item of landed feeds, a file each, or one a line of files that are ``bundled``."""
    if bundled:
        feeds = read_documents(spark, path, bundled)
        items = F.from_xml("doc", f"channel struct<item: array<struct<{RSS_COLUMNS}>>>", {"mode": "FAILFAST"})["channel"]["item"]
        return feeds.select(F.explode(items).alias("_i"), *[c for c in feeds.columns if c not in ("doc", "path")]).select("_i.*", "*").drop("_i")
    return spark.read.format("xml").option("rowTag", "item").option("mode", "FAILFAST").schema(RSS_ITEM).load(path)


def rss_items(items: DataFrame, source: str = "source") -> DataFrame:
    """(date, title, link, description, source): missing texts are empty, the date may be NULL; latest per
    (source, link)."""
    flat = items.select(
        X.mail_date(F.col("pubDate")).alias("date"), X.clean(F.col("title")).alias("title"),
        X.clean(F.col("link")).alias("link"), X.plain_text(F.coalesce("description", F.lit(""))).alias("description"),
        F.col(source).alias("source"),
    )
    return keep_one(flat, ["source", "link"], ["date"], "last")


def daily_bars(raw: DataFrame) -> DataFrame:
    """(date, open, high, low, close) from vendor columns Date, Open, High, Low, Close; first row per date."""
    cols = [F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")]
    return keep_one(nan_to_null(raw.select(F.to_date("Date").alias("date"), *cols)), ["date"], [], "first")


def paired_closes(raw: DataFrame, tickers: dict[str, str]) -> DataFrame:
    """(date, <name>_close…) from long rows (date, ticker, close); dates without any close are dropped."""
    named = raw.filter(F.col("ticker").isin(list(tickers.values())))
    wide = named.groupBy("date").pivot("ticker", list(tickers.values())).agg(F.min("close"))
    renamed = wide.select("date", *[F.col(f"`{t}`").alias(f"{name}_close") for name, t in tickers.items()])
    return nan_to_null(renamed).dropna(how="all", subset=[f"{name}_close" for name in tickers])


def surface_points(sheet: DataFrame, deltas: list[str], refdate: str = "refdate", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, refdate, maturity_date, delta_pct, iv_pct) from a wide sheet; first row per point."""
    long = wide_to_long(sheet, [*keys, refdate], deltas)
    return keep_one(long, [*keys, refdate, "maturity_date", "delta_pct"], [], "first")


def read_series(
    spark: SparkSession, path: str, value: str, keys: dict[str, str] | None = None, time: str = "date",
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """(date, value) of one key of a clean table, from ``start`` to ``end``, both included.

    A missing table is an error; the filters reach the scan.
    """
    df = spark.read.parquet(path)
    for column, wanted in (keys or {}).items():
        df = df.filter(F.col(column) == wanted)
    if start:
        df = df.filter(F.col(time) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(time) <= F.lit(end).cast("date"))
    return df.select(F.col(time).alias("date"), F.col(value))


def read_futures_prices(spark: SparkSession, path: str) -> DataFrame:
    """(date, close, high, low): settlement per unit of currency, the contract being quoted per 1000."""
    df = spark.read.parquet(path)
    return df.select("date", (F.col("settlement") / 1000).alias("close"), "high", "low", "contract_changed")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result blocks, one JSON object per line, NULLs written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)

