"""Reports of drawings as one HTML file: a title, blocks by context, drawings in each."""

from __future__ import annotations

from html import escape

from pyspark.sql import SparkSession

STYLE = "body{font-family:sans-serif;max-width:1320px;margin:2em auto}section{border-top:1px solid #ccc;padding:1em 0}svg{max-width:100%;height:auto}"


def page(title: str, blocks: dict[str, dict[str, str]]) -> str:
    """``blocks``: heading -> caption -> SVG."""
    body = "".join(
        f"<section><h2>{escape(heading)}</h2>" + "".join(f"<figure>{drawing}<figcaption>{escape(caption)}</figcaption></figure>" for caption, drawing in drawings.items()) + "</section>"
        for heading, drawings in blocks.items())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def save(spark: SparkSession, path: str, text: str) -> None:
    """Writes one text file through Spark's file systems, so that any path a table may have will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
