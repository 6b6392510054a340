"""Results as delimited text, HTML rows and Arrow streams, and the arithmetic of pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZES = (50, 100, 250)


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """line: each row as delimited text; null is empty, and text with a comma, quote or line break is quoted, quotes doubled."""

    def cell(name: str) -> Column:
        text = _text(name)
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def html_rows(df: DataFrame) -> DataFrame:
    """line: each row as a row of an HTML table, with &, <, >, double and single quotes escaped; null is an empty cell."""

    def cell(name: str) -> Column:
        text = _text(name)
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            text = F.replace(text, F.lit(raw), F.lit(entity))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>")).alias("line"))


def arrow_streams(df: DataFrame) -> DataFrame:
    """stream: the rows as Arrow IPC streams, one for each batch, each with its schema; a frame without rows gives none."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"stream": [sink.getvalue().to_pybytes()]}, pa.schema([("stream", pa.binary())]))

    return df.mapInArrow(pack, "stream binary")


def from_arrow_streams(streams: DataFrame, schema) -> DataFrame:
    """The rows of a column of Arrow IPC streams; a null stream has none."""

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("stream"):
                if data.is_valid:
                    yield from pa.ipc.open_stream(data.as_buffer())

    return streams.select("stream").mapInArrow(unpack, schema)


def page_window(df: DataFrame, page: int, size: int = PAGE_SIZES[0]) -> DataFrame:
    """size, rows, pages, page, first, last: one page of a table; a page beyond the ends is moved to the nearest, an empty table has one empty page (0 to 0)."""
    if size not in PAGE_SIZES:
        raise ValueError(f"a page holds one of {PAGE_SIZES} rows")
    n = F.col("rows")
    pages = F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    at = F.least(F.greatest(F.lit(page).cast("long"), F.lit(1).cast("long")), F.col("pages"))
    t = df.agg(F.count("*").alias("rows")).withColumn("pages", pages).withColumn("page", at)
    return t.select(F.lit(size).alias("size"), "rows", "pages", "page", F.least((F.col("page") - 1) * size + 1, n).alias("first"), F.least(F.col("page") * size, n).alias("last"))
