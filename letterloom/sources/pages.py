"""Text of saved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import html_to_text


def page_text(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, text`` of a table of pages."""
    return pages.select(key, html_to_text(F.col(html)).alias("text"))


def file_text(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """``path, text`` of page files from a scan."""
    return page_text(files.select("path", F.decode("content", charset).alias("html")), "path")
