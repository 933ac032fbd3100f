"""All kinds of files that the query over content types had, and their subtypes."""

import duckdb
import pandas as pd

from lodeworks.plans import derived
from lodeworks.plans.registry import ORACLES


def test_every_kind_and_subtype_is_made_and_told(spark, tmp_path):
    orders = pd.DataFrame({"o_orderkey": range(1, 46), "o_orderpriority": ["1-URGENT"] * 45})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = derived.content_types(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("orders", orders)
    want = con.execute(ORACLES["content_types"]).df()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))
    kinds = set(zip(got["doc_type"], got["subtype"], got["declined"], strict=True))
    assert kinds >= {("office", x, False) for x in ("docx", "xlsx", "pptx", "odt", "rtf")} | {("unsupported", "", True), ("archive", "", False), ("legacy-office", "", True)}
    assert len(set(got["filename"].str.replace(r"^f\d+", "", regex=True))) == 15
