"""Landed JSON documents to clean tables.

``read_documents`` gives one row per response of a public API, small each: landed as a file of its own, or bundled, one a line. Many
responses belong in bundles, because every file costs a listing, an opening and a commit, whatever it holds. The parsers take any frame
with a ``doc`` column, so the same code serves batch, streaming and documents held in a table. Schemas are
explicit and malformed JSON fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions import text as X
from volpanel.operators.keep import keep_one, union_all

# Field names of the public services' responses.
POINTS = "array<struct<data:string,valor:string>>"
TIMELINE = "struct<timeline:array<struct<series:string,data:array<struct<date:string,value:double,norm:double>>>>>"
ARTICLES = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>>"
MINUTES = "struct<conteudo:array<struct<nroReuniao:int,dataReferencia:string,titulo:string,textoAta:string,urlPdfAta:string>>>"
STATEMENTS = "struct<conteudo:array<struct<nro_reuniao:int,dataReferencia:string,titulo:string,textoComunicado:string>>>"
MEETINGS = "struct<conteudo:array<struct<nroReuniao:int,nro_reuniao:int>>>"
SURVEY = (
    "struct<value:array<struct<Data:string,Suavizada:string,Media:double,Mediana:double,DesvioPadrao:double,"
    "numeroRespondentes:int,baseCalculo:int>>>"
)
RELEASE_LAG_DAYS = 60


def read_documents(spark: SparkSession, path: str | list[str], bundled: bool = False) -> DataFrame:
    """(doc, path, folder columns): one row per landed file, whole content, or per line of files that are ``bundled``;
    ``name=value`` folders become columns."""
    # As an argument: ``text`` sets the option of that name to its own default.
    files = spark.read.text(path, wholetext=not bundled, lineSep="\n" if bundled else None)
    folders = [c for c in files.columns if c != "value"]
    return files.select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("path"), *folders)


def _items(docs: DataFrame, schema: str, items: str | None, *keep: Column) -> DataFrame:
    parsed = F.from_json("doc", schema, {"mode": "FAILFAST"})
    array = parsed if items is None else parsed[items]
    return docs.select(*keep, F.explode(array).alias("i"))


def official_rate(docs: DataFrame, series: str = "tipo") -> DataFrame:
    """(date, value, tipo); first value per (tipo, date). ``series`` names the column saying which rate a
    document holds."""
    rows = _items(docs, POINTS, None, F.col(series).alias("tipo"))
    flat = rows.select(X.day_first(F.col("i.data")).alias("date"), F.col("i.valor").cast("double").alias("value"), "tipo")
    return keep_one(flat, ["tipo", "date"], [], "first")


def _timeline(docs: DataFrame, query: str) -> DataFrame:
    parsed = F.from_json("doc", TIMELINE, {"mode": "FAILFAST"})
    points = docs.select(F.col(query).alias("query"), F.explode(F.get(parsed["timeline"], F.lit(0))["data"]).alias("i"))
    return points.withColumn("date", X.compact_utc(F.col("i.date")))


def news_tone(docs: DataFrame, query: str = "query") -> DataFrame:
    """(date, tone, query), the instant kept so that an as-of join sees a UTC day at the previous local evening."""
    flat = _timeline(docs, query).select("date", F.col("i.value").alias("tone"), "query")
    return keep_one(flat, ["query", "date"], [], "last")


def news_volume(docs: DataFrame, query: str = "query") -> DataFrame:
    """(date, article_count, total_monitored, share_pct, query)."""
    count, total = F.col("i.value").cast("long"), F.col("i.norm").cast("long")
    flat = _timeline(docs, query).select(
        "date", count.alias("article_count"), total.alias("total_monitored"),
        (F.try_divide(count, total) * 100).alias("share_pct"), "query",
    )
    return keep_one(flat, ["query", "date"], [], "last")


def headlines(docs: DataFrame, query: str = "query") -> DataFrame:
    """(date, title, url, domain, language, sourcecountry, query); latest per (query, url)."""
    rows = _items(docs, ARTICLES, "articles", F.col(query).alias("query"))
    flat = rows.select(
        X.compact_utc(F.col("i.seendate")).alias("date"),
        *[F.col(f"i.{c}") for c in ("title", "url", "domain", "language", "sourcecountry")], "query",
    )
    return keep_one(flat, ["query", "url"], ["date"], "last")


def meeting_numbers(docs: DataFrame) -> DataFrame:
    """Meeting numbers named in list responses of either kind."""
    rows = _items(docs, MEETINGS, "conteudo")
    return rows.select(F.coalesce("i.nroReuniao", "i.nro_reuniao").alias("nro_reuniao")).distinct()


def _meeting(docs: DataFrame, schema: str, kind: str, number: str, body: str, pdf: str | None) -> DataFrame:
    parsed = F.get(F.from_json("doc", schema, {"mode": "FAILFAST"})["conteudo"], F.lit(0))
    rows = docs.select(parsed.alias("i")).filter(F.col("i").isNotNull())
    return rows.select(
        F.col(f"i.{number}").alias("nro_reuniao"), F.lit(kind).alias("tipo"),
        F.to_date(F.substring("i.dataReferencia", 1, 10)).alias("data_referencia"), F.col("i.titulo").alias("titulo"),
        X.plain_text(F.col(f"i.{body}")).alias("texto"),
        (F.col(f"i.{pdf}") if pdf else F.lit(None).cast("string")).alias("url_pdf"),
    )


def meeting_documents(minutes: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
    """Minutes and statements in one schema, markup removed; latest per (nro_reuniao, tipo)."""
    frames = []
    if minutes is not None:
        frames.append(_meeting(minutes, MINUTES, "ata", "nroReuniao", "textoAta", "urlPdfAta"))
    if statements is not None:
        frames.append(_meeting(statements, STATEMENTS, "comunicado", "nro_reuniao", "textoComunicado", None))
    return keep_one(union_all(frames), ["nro_reuniao", "tipo"], ["data_referencia"], "last")


def survey_expectations(docs: DataFrame) -> DataFrame:
    """(date, pi_expectation, pi_median, dispersion, n_respondentes): unsmoothed rows of the base sample."""
    rows = _items(docs, SURVEY, "value").filter((F.col("i.Suavizada") == "N") & (F.col("i.baseCalculo") == 0))
    flat = rows.select(
        F.to_date("i.Data").alias("date"), F.col("i.Media").alias("pi_expectation"),
        F.col("i.Mediana").alias("pi_median"), F.col("i.DesvioPadrao").alias("dispersion"),
        F.col("i.numeroRespondentes").alias("n_respondentes"),
    )
    return keep_one(flat, ["date"], [], "first")


def yearly_targets(docs: DataFrame) -> DataFrame:
    """(year, meta)."""
    rows = _items(docs, POINTS, None)
    return rows.select(F.year(X.day_first(F.col("i.data"))).alias("year"), F.col("i.valor").cast("double").alias("meta"))


def activity_index(docs: DataFrame, lag_days: int = RELEASE_LAG_DAYS) -> DataFrame:
    """(reference_date, release_date, value): a month's figure counts from its estimated release on."""
    rows = _items(docs, POINTS, None)
    day = X.day_first(F.col("i.data"))
    flat = rows.select(
        day.alias("reference_date"), F.date_add(day, lag_days).alias("release_date"), F.col("i.valor").cast("double").alias("value")
    )
    return keep_one(flat, ["reference_date"], [], "first")
