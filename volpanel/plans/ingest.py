"""Landed folders to clean tables: parse, key and keep rule of each table, and a partitioned merge into what is there.

A landed folder holds whole responses, one file each or bundled one a line, in ``name=value`` folders where a file belongs to a query, a rate or a
source. Ingesting the same files again, or files that overlap with earlier ones, leaves the table as it was.

========== ============================ ================ ======= ==============
table      landed as                    key              keeps   partitions
========== ============================ ================ ======= ==============
official   JSON, tipo=…                 tipo, date       first   tipo
tone       JSON, query=…                query, date      last    month
volume     JSON, query=…                query, date      last    month
headlines  JSON, query=…                query, url       last    hash of key
meetings   JSON, tipo=ata|comunicado    nro_reuniao,tipo last    tipo
rss        XML, source=…                source, link     last    hash of key
survey     JSON                         date             first   month
activity   JSON                         reference_date   first   year
surface    wide CSV, series_id=…        refdate, maturity, delta first month
========== ============================ ================ ======= ==============
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators.keep import PART, hash_part, read_table, upsert_table
from volpanel.sources import documents as docs
from volpanel.sources import exchange


@dataclass(frozen=True)
class CleanTable:
    """How landed files become rows, what identifies a row, which of two stays, and how the table is split."""

    parse: Callable[[SparkSession, str, bool], DataFrame]  # of a folder whose documents are bundled, or not
    keys: tuple[str, ...]
    time: str
    keep: str
    part: Column
    own_part: str | None = None  # a key column that is the partition itself

    @property
    def part_column(self) -> str:
        return self.own_part or PART


def _month(column: str) -> Column:
    return F.year(column) * 100 + F.month(column)


def _meetings(spark: SparkSession, landed: str, bundled: bool) -> DataFrame:
    read = docs.read_documents(spark, landed, bundled)
    return docs.meeting_documents(read.filter("tipo = 'ata'"), read.filter("tipo = 'comunicado'"))


def _surface(spark: SparkSession, landed: str, bundled: bool) -> DataFrame:
    sheet = spark.read.option("header", True).csv(landed)
    fixed = {"series_id", "refdate", "maturity_date"}
    sheet = sheet.withColumn("refdate", F.to_date("refdate"))
    return exchange.surface_points(sheet, [c for c in sheet.columns if c not in fixed], keys=("series_id",))


TABLES = {
    "official": lambda: CleanTable(lambda s, p, b: docs.official_rate(docs.read_documents(s, p, b)), ("tipo", "date"), "date", "first", F.col("tipo"), "tipo"),
    "tone": lambda: CleanTable(lambda s, p, b: docs.news_tone(docs.read_documents(s, p, b)), ("query", "date"), "date", "last", _month("date")),
    "volume": lambda: CleanTable(lambda s, p, b: docs.news_volume(docs.read_documents(s, p, b)), ("query", "date"), "date", "last", _month("date")),
    "headlines": lambda: CleanTable(lambda s, p, b: docs.headlines(docs.read_documents(s, p, b)), ("query", "url"), "date", "last", hash_part(["query", "url"])),
    "meetings": lambda: CleanTable(_meetings, ("nro_reuniao", "tipo"), "data_referencia", "last", F.col("tipo"), "tipo"),
    "rss": lambda: CleanTable(lambda s, p, b: exchange.rss_items(exchange.read_rss(s, p, b)), ("source", "link"), "date", "last", hash_part(["source", "link"])),
    "survey": lambda: CleanTable(lambda s, p, b: docs.survey_expectations(docs.read_documents(s, p, b)), ("date",), "date", "first", _month("date")),
    "activity": lambda: CleanTable(
        lambda s, p, b: docs.activity_index(docs.read_documents(s, p, b)), ("reference_date",), "reference_date", "first", F.year("reference_date")
    ),
    "surface": lambda: CleanTable(
        _surface, ("series_id", "refdate", "maturity_date", "delta_pct"), "refdate", "first", _month("refdate")
    ),
}


def clean(spark: SparkSession, path: str) -> DataFrame:
    """A clean table without its partition column."""
    return read_table(spark, path).drop(PART)


def ingest(spark: SparkSession, name: str, landed: str, path: str, bundled: bool = False) -> DataFrame:
    """Merge the files landed in a folder into the clean table at ``path``; returns the table. Documents and feeds may be ``bundled``,
    one a line; sheets are read by row in any case."""
    table = TABLES[name]()
    rows = table.parse(spark, landed, bundled)
    if not table.own_part:
        rows = rows.withColumn(PART, table.part)
    upsert_table(rows, path, table.keys, table.time, table.keep, [table.part_column])
    return clean(spark, path)
