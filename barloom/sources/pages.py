"""Landed pages and vendor payloads to bars and quotes, with regular expressions and JSON functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_symbol, number_from_cell, valid_symbol

ROW, CELL = r"(?s)<tr[^>]*>(.*?)</tr>", r"(?s)<td[^>]*>(.*?)</td>"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once a row: a plain column is put into every expression that reads it, and a regular expression run again in each."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def html_rows(pages: DataFrame) -> DataFrame:
    """Each table row of ``html`` with its position and its cells."""
    found = once(pages, rows=F.regexp_extract_all("html", F.lit(ROW), F.lit(1))).drop("html")
    rows = found.select(*[c for c in found.columns if c != "rows"], F.posexplode("rows").alias("at", "row"))
    return once(rows, cells=F.regexp_extract_all("row", F.lit(CELL), F.lit(1)))


def parse_history_pages(pages: DataFrame) -> DataFrame:
    """Bars of history tables (symbol, html): epoch seconds in ``data-order`` of the first cell, then open, high, low, close, volume. Rows with any bad cell go."""
    names = ("open", "high", "low", "close", "volume")
    sec = F.regexp_extract("row", r'data-order="(\d+)"', 1).try_cast("long")
    r = once(html_rows(pages.select("symbol", "html")), sec=sec, **{n: number_from_cell(F.get("cells", F.lit(i + 1))) for i, n in enumerate(names)})
    r = r.select("symbol", F.timestamp_seconds("sec").alias("ts"), *names)
    ok = F.col("ts").isNotNull()
    for n in names:
        ok = ok & finite(F.col(n))
    return r.where(ok)


def parse_quote_pages(pages: DataFrame) -> DataFrame:
    """Quotes of market tables (page_id, html): symbol, close, volume; the first row of a symbol on a page wins."""
    cell = lambda i: F.get("cells", F.lit(i))
    r = once(html_rows(pages.select("page_id", "html")), symbol=normalize_symbol(cell(0)), close=number_from_cell(cell(1)), volume=number_from_cell(cell(2)))
    r = r.where(valid_symbol(F.col("symbol")) & finite(F.col("close")) & finite(F.col("volume")))
    return r.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "symbol").orderBy("at"))).where("nth = 1").select("page_id", "symbol", "close", "volume")


def normalize_vendor_json(payloads: DataFrame) -> DataFrame:
    """Bars of vendor arrays (symbol, payload): aliases of time and price, missing prices are the close, bad volume is 0; bad time or close <= 0 goes."""
    item = "array<struct<timestamp:bigint,time:bigint,date:bigint,open:double,high:double,low:double,close:double,last:double,price:double,volume:double>>"
    r = payloads.select("symbol", F.explode(F.from_json("payload", item)).alias("x"))
    close = F.coalesce("x.close", "x.last", "x.price")
    r = r.select("symbol", F.timestamp_millis(F.coalesce("x.timestamp", "x.time", "x.date")).alias("ts"), *[F.coalesce(F.col(f"x.{c}"), close).alias(c) for c in ("open", "high", "low")], close.alias("close"), F.when(finite(F.col("x.volume")), F.col("x.volume")).otherwise(0.0).alias("volume"))
    return r.where(F.col("ts").isNotNull() & (F.col("close") > 0))


def normalize_chart_json(payloads: DataFrame) -> DataFrame:
    """Bars of a chart payload (symbol, payload) of parallel arrays; bars with zero or missing close or volume go."""
    arrays = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
    r = payloads.select("symbol", F.from_json("payload", arrays).alias("p")).select("symbol", F.explode(F.arrays_zip("p.timestamp", "p.open", "p.high", "p.low", "p.close", "p.volume")).alias("x"))
    r = r.select("symbol", F.timestamp_seconds("x.timestamp").alias("ts"), "x.open", "x.high", "x.low", "x.close", "x.volume")
    return r.where((F.col("close") > 0) & (F.col("volume") > 0))


def write_audit(audit: DataFrame, path: str) -> None:
    """Append per-symbol audit rows, partitioned by run_date."""
    audit.repartition("run_date").write.mode("append").partitionBy("run_date").parquet(path)
