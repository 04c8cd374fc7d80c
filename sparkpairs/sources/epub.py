"""EPUB containers as a table of document items.

Files are read with the ``binaryFile`` source (one row per container, split
across tasks); each task opens its containers with the standard-library
``zipfile`` and emits one row per XHTML document listed in the package
manifest. Nothing is gathered on the driver. A container or item that cannot be
read gives a row with ``error`` set and ends nothing else.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from typing import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.sources.html import chapter_file_name
from sparkpairs.sources.html_parser import html_documents

ITEM_SCHEMA = "source string, item_name string, html string, error string"
DOCUMENT_TYPE = "application/xhtml+xml"


def epub_items(data: bytes) -> list[tuple[str, str | None, str | None]]:
    """(item name, decoded html, error) for each document item of one container."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        rootfile = next(el.attrib["full-path"] for el in container.iter() if el.tag.endswith("rootfile"))
        base = posixpath.dirname(rootfile)
        opf = ET.fromstring(z.read(rootfile))
        for el in opf.iter():
            if el.tag.endswith("item") and el.attrib.get("media-type") == DOCUMENT_TYPE:
                href = unquote(el.attrib["href"])
                try:
                    out.append((href, z.read(posixpath.normpath(posixpath.join(base, href))).decode("utf-8"), None))
                except (KeyError, ValueError, zipfile.BadZipFile) as e:  # not in the archive, not UTF-8, damaged
                    out.append((href, None, f"{type(e).__name__}: {e}"))
    return out


def _explode_containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):  # a book at a time
            try:
                items = epub_items(bytes(content))
            except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration) as e:
                items = [(None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame([(path, *item) for item in items], columns=["source", "item_name", "html", "error"])


def read_epub(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source, item_name, html, error`` of every document item; ``html`` is null where ``error`` is set."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(paths)
    return raw.select("path", "content").mapInPandas(_explode_containers, ITEM_SCHEMA)


def epub_to_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stage 1 of the corpus build: ``source, chapter, text`` per readable document item
    (``read_epub`` lists the others with their errors)."""
    items = read_epub(spark, paths).filter("error IS NULL").select("source", "item_name", "html")
    texts = html_documents(items, ["source", "item_name"], out="text")
    return texts.select("source", chapter_file_name("item_name").alias("chapter"), "text")
