"""Documents in the layout of the public sources, built by Spark from the driver's tables.

The text of each document holds one month, one day or a few items, so no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.sources.exchange import RSS_ITEM, parse_price_reports
from volpanel.workload import tables as S


def _points(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """[{data: 'dd/MM/yyyy', valor: '…'}] per group, four decimals."""
    point = F.struct(F.date_format(day, "dd/MM/yyyy").alias("data"), F.col(value).cast("decimal(18,4)").cast("string").alias("valor"))
    return df.groupBy(*by).agg(F.to_json(F.collect_list(point)).alias("doc"))


def official_rate(spark: SparkSession, sf: str) -> DataFrame:
    """One document per priority and month; every month is sent twice."""
    daily = S.official(spark, sf).withColumnRenamed("series_id", "tipo").withColumn("month", F.trunc("date", "month"))
    once = _points(daily, ["tipo", "month"], "date", "value")
    return once.unionByName(once)


def timelines(spark: SparkSession, sf: str) -> DataFrame:
    """{timeline: [{series, data: [{date, value, norm}]}]} per event type and day, hourly points."""
    point = F.struct(
        F.date_format("date", "yyyyMMdd'T'HHmmss'Z'").alias("date"), F.col("events").cast("double").alias("value"),
        F.col("total").cast("double").alias("norm"),
    )
    hourly = S.hourly_share(spark, sf).groupBy(F.col("series_id").alias("query"), F.to_date("date").alias("day"))
    line = F.struct(F.lit("Volume").alias("series"), F.collect_list(point).alias("data"))
    return hourly.agg(F.to_json(F.struct(F.array(line).alias("timeline"))).alias("doc"))


def article_lists(spark: SparkSession, sf: str) -> DataFrame:
    """{articles: […]} of twenty documents each; three documents of a query share an address, however many there are."""
    h = S.headlines(spark, sf)
    item = F.struct(
        F.concat(F.lit("u/"), (F.col("doc_id") % 20 + 20 * F.floor(F.col("doc_id") / 60)).cast("string")).alias("url"), "title",
        F.date_format("date", "yyyyMMdd'T'120000'Z'").alias("seendate"), F.concat("query", F.lit(".example")).alias("domain"),
        "language", F.upper("language").alias("sourcecountry"),
    )
    few = h.groupBy("query", F.floor(F.col("doc_id") / 20).alias("part")).agg(F.collect_list(item).alias("articles"))
    return few.select("query", F.to_json(F.struct("articles")).alias("doc"))


def meetings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(minutes, statements): even and odd pages in the two response shapes."""
    day = F.date_format(F.date_add(F.lit(S.FIRST_DAY).cast("date"), (F.col("page_id") % S.HEADLINE_DAYS).cast("int")), "yyyy-MM-dd")
    p = S.table(spark, sf, "pages").withColumn("day", day)
    number = F.col("page_id").cast("int")

    def wrap(rows: DataFrame, *fields) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.array(F.struct(*fields)).alias("conteudo"))).alias("doc"))

    common = (F.col("day").alias("dataReferencia"), F.col("url").alias("titulo"))
    minutes = wrap(
        p.filter("page_id % 2 = 0"), number.alias("nroReuniao"), *common, F.col("html").alias("textoAta"), F.col("url").alias("urlPdfAta")
    )
    return minutes, wrap(p.filter("page_id % 2 = 1"), number.alias("nro_reuniao"), *common, F.col("html").alias("textoComunicado"))


def survey(spark: SparkSession, sf: str) -> DataFrame:
    """{value: […]} per month; each day also has a smoothed row and one of the other sample."""
    kinds = F.array(*[F.struct(F.lit(s).alias("Suavizada"), F.lit(b).alias("baseCalculo")) for s, b in (("N", 0), ("S", 0), ("N", 1))])
    o = S.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).cast("int").alias("n")
    )
    rows = o.withColumn("_k", F.explode(kinds))
    item = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("Data"), F.col("_k.Suavizada").alias("Suavizada"),
        (F.round(F.col("mean") / S.PRICE_UNIT, 4) + F.col("_k.baseCalculo")).alias("Media"), F.round(F.col("mean") / S.PRICE_UNIT, 2).alias("Mediana"),
        F.round(F.col("sd") / S.PRICE_UNIT, 4).alias("DesvioPadrao"), F.col("n").alias("numeroRespondentes"), F.col("_k.baseCalculo").alias("baseCalculo"),
    )
    docs = rows.groupBy(F.trunc("date", "month").alias("month")).agg(F.collect_list(item).alias("value"))
    return docs.select(F.to_json(F.struct("value")).alias("doc"))


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    t = S.targets(spark, sf).withColumn("day", F.make_date("year", F.lit(1), F.lit(1)))
    return _points(t, ["year"], "day", "meta").drop("year")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Order counts of all priorities by month, one document per year."""
    o = S.table(spark, sf, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("day")).agg(F.count(F.lit(1)).alias("v"))
    return _points(o, [F.year("day").alias("y")], "day", "v").drop("y")


def land(docs: DataFrame, path: str, by: str | None = None) -> str:
    """Write the column ``doc`` in bundles, one document a line, in folders by ``by``: the files grow with the bytes and not with the documents.

    A line break in a document becomes a blank; JSON and XML items have them between their tokens only, or escaped.
    """
    line = F.translate("doc", "\n\r", "  ").alias("doc")
    writer = docs.select(line, *([by] if by else [])).write.option("lineSep", "\n").mode("append")
    (writer.partitionBy(by) if by else writer).text(path)
    return path


def _escape(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def report_texts(spark: SparkSession, sf: str, by) -> DataFrame:
    """(package, snapshot, doc): reports of futures and options as XML text, two snapshots of each package ``by``, the first one stale."""
    c = S.contracts(spark, sf).filter(F.col("ticker").isNotNull())
    k = F.regexp_extract("ticker", r"([0-9]+)$", 1).cast("int")
    code = F.concat(F.lit("DOL"), F.char(65 + k % 26), F.lpad(k.cast("string"), 2, "0"), F.when(k > 20, F.lit("C005600")).otherwise(F.lit("")))
    snap = F.explode(F.array(F.struct(F.lit("a.xml").alias("file"), F.lit(1).alias("off")), F.struct(F.lit("b.xml").alias("file"), F.lit(0).alias("off"))))
    rows = c.withColumn("_s", snap)
    tag = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f'<{name} Ccy="BRL">'), v.cast("string"), F.lit(f"</{name}>"))).otherwise(F.lit(""))
    plain = lambda name, v: F.concat(F.lit(f"<{name}>"), v.cast("string"), F.lit(f"</{name}>"))
    settled = F.when(k % 7 != 0, F.round(F.col("settlement") * 1000, 3) + F.col("_s.off"))
    xml = F.concat(
        F.lit("<PricRpt><TradDt><Dt>"), F.col("date").cast("string"), F.lit("</Dt></TradDt><SctyId><TckrSymb>"), code,
        F.lit("</TckrSymb></SctyId><FinInstrmAttrbts>"), tag("AdjstdQt", settled),
        tag("FrstPric", F.round(F.col("open") * 1000, 3)), tag("LastPric", F.round(F.col("last") * 1000, 3)),
        tag("MinPric", F.round(F.col("low") * 1000, 3)), tag("MaxPric", F.round(F.col("high") * 1000, 3)),
        plain("OpnIntrst", F.col("open_interest")), plain("TradQty", F.col("trades")), F.lit("</FinInstrmAttrbts></PricRpt>"),
    )
    day = rows.select(by.alias("package"), F.col("_s.file").alias("snapshot"), xml.alias("x")).groupBy("package", "snapshot")
    report = F.concat(F.lit("<Document>"), F.array_join(F.collect_list("x"), ""), F.lit("</Document>"))
    return day.agg(report.alias("doc"))


def price_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Daily reports parsed from text."""
    return parse_price_reports(report_texts(spark, sf, F.col("date")))


def price_report_files(spark: SparkSession, sf: str, path: str) -> str:
    """Reports landed as files, one package a quarter with a folder for each of its snapshots."""
    quarter = F.concat(F.year("date"), F.lit("Q"), F.quarter("date"))
    docs = report_texts(spark, sf, quarter)
    docs.write.partitionBy("package", "snapshot").option("lineSep", "\n").text(path)
    return path


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """(source, doc): feeds of up to fifty items each: every tenth item has no date, every seventh no description."""
    items = _feed_items(spark, sf).groupBy("source", F.floor(F.col("page_id") / 150).alias("part")).agg(F.array_join(F.collect_list("xml"), "").alias("x"))
    return items.select("source", "part", F.concat(F.lit("<rss><channel>"), F.regexp_replace("x", "[\\n\\r]", " "), F.lit("</channel></rss>")).alias("doc"))


def _feed_items(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages")
    day = F.date_add(F.lit(S.FIRST_DAY).cast("date"), (F.col("page_id") % S.HEADLINE_DAYS).cast("int"))
    stamp = F.concat(F.lit("Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 22:30:00 -0300"))
    optional = lambda name, keep, v: F.when(keep, F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit("<item><title>  "), _escape(F.col("url")), F.lit(" </title><link>"), F.col("page_id").cast("string"), F.lit("</link>"),
        optional("pubDate", F.col("page_id") % 10 != 0, stamp),
        optional("description", F.col("page_id") % 7 != 0, _escape(F.col("html"))), F.lit("</item>"),
    )
    return p.select("page_id", xml.alias("xml"), (F.col("page_id") % 3).cast("string").alias("source"))


def rss(spark: SparkSession, sf: str) -> DataFrame:
    """The feed items parsed from XML text."""
    parsed = _feed_items(spark, sf).select(F.from_xml("xml", RSS_ITEM, {"mode": "FAILFAST"}).alias("x"), "source")
    return parsed.select("x.*", "source")


def wide_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Surface quotes of every series, one sheet column per delta; January cells of the lowest delta are not numbers."""
    s = S.surface(S.bars(spark, sf))
    wide = s.groupBy("series_id", "refdate", "maturity_date").pivot("delta_pct", [25.0, 50.0, 75.0]).agg(F.first("iv_pct"))
    cell = F.when(F.month("refdate") == 1, F.lit("n/a")).otherwise(F.col("`25.0`").cast("string"))
    text = wide.select("series_id", "refdate", F.col("maturity_date").cast("string").alias("maturity_date"), cell.alias("25"),
                       F.col("`50.0`").cast("string").alias("50"), F.col("`75.0`").cast("string").alias("75"))
    notes = text.select("series_id", "refdate", F.lit("total").alias("maturity_date"), "25", "50", "75").distinct()
    return text.unionByName(notes)


def vendor_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor columns of the whole market's bars, each day delivered twice."""
    px = S.unit_price()
    raw = S.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("Date")).agg(
        F.min(px).alias("Open"), F.max(px).alias("High"), F.min(px).alias("Low"), F.max(px).alias("Close"), F.count(F.lit(1)).alias("Volume")
    )
    return raw.unionByName(raw)
