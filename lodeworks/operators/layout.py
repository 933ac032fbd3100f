"""Page layout: positioned words into lines of text, as a reader sees the page.

A cell is a word with its box. Cells whose baselines lie within a tolerance share
a row; a column is a cell's left edge over the page's character pitch; a gap far
above the usual distance of rows makes a paragraph. A page is bounded, so one
task lays out one page; a document's pages are joined in order.
"""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH = 1.8


def page_text(cells: list[tuple[str, float, float, float, float]]) -> str:
    """Text of one page from (text, left, top, right, bottom); y grows downwards."""
    cells = [c for c in cells if c[0].strip()]
    if not cells:
        return ""
    height = median(c[4] - c[2] for c in cells)
    near = max(2.0, height / 2)
    pitch = max(1.0, median((c[3] - c[1]) / len(c[0]) for c in cells))
    rows: list[list] = []
    for c in sorted(cells, key=lambda c: (c[4], c[1])):
        if rows and c[4] - rows[-1][-1][4] <= near and c[4] - rows[-1][0][4] <= near:
            rows[-1].append(c)
        else:
            rows.append([c])
    steps = [b[0][4] - a[0][4] for a, b in zip(rows, rows[1:], strict=False)]
    usual = median(steps) if steps else 0
    left = min(c[1] for c in cells)
    out = []
    for n, row in enumerate(rows):
        if n and usual and steps[n - 1] > PARAGRAPH * usual:
            out.append("")
        line = ""
        for c in sorted(row, key=lambda c: c[1]):
            column = round((c[1] - left) / pitch)
            line += " " * max(column - len(line), 1 if line else 0) + c[0]
        out.append(line.rstrip())
    return "\n".join(out).strip("\n")


def lay_out(cells: DataFrame) -> DataFrame:
    """(doc_id, text) from cells (doc_id, page, text, left, top, right, bottom)."""
    kind = cells.schema["doc_id"].dataType.simpleString()

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["text", "left", "top", "right", "bottom"]].itertuples(index=False, name=None))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "page": [pdf["page"].iloc[0]], "text": [page_text(rows)]})

    pages = cells.groupBy("doc_id", "page").applyInPandas(page, f"doc_id {kind}, page int, text string").filter("text <> ''")
    ordered = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return ordered.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def scanned(pages: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, digital): a document is digital if its pages hold ``least`` letters and digits on average."""
    dense = F.length(F.regexp_replace("text", r"[^\p{L}\p{Nd}]", ""))
    return pages.groupBy("doc_id").agg((F.sum(dense) >= F.count("*") * least).alias("digital"))

