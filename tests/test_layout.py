from lodeworks.operators import layout


def cell(text, left, top):
    return (text, left, top, left + 6 * len(text), top + 10)


def test_rows_columns_and_paragraphs():
    cells = [cell("Total", 0, 0), cell("12.00", 60, 1), cell("Tax", 0, 12), cell("2.00", 60, 12), cell("Sum", 0, 24), cell("End", 0, 60)]
    assert layout.page_text(cells).split("\n") == ["Total     12.00", "Tax       2.00", "Sum", "", "End"]
    assert layout.page_text([]) == "" and layout.page_text([cell("é", 0, 0), cell("x", 60, 0)]) == "é         x"


def test_pages_in_order(spark):
    rows = [(1, p, f"page{p}", 0.0, 0.0, 30.0, 10.0) for p in (3, 1, 2)] + [(2, 1, " ", 0.0, 0.0, 5.0, 10.0)]
    t = spark.createDataFrame(rows, "doc_id int, page int, text string, left double, top double, right double, bottom double")
    assert [tuple(r) for r in layout.lay_out(t).collect()] == [(1, "page1\n\npage2\n\npage3")]
    d = spark.createDataFrame([(1, "x" * 150), (1, "y" * 60), (2, "z")], "doc_id int, text string")
    assert {r["doc_id"]: r["digital"] for r in layout.scanned(d).collect()} == {1: True, 2: False}
