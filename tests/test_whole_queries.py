"""Queries over whole tables, where SQL states a part, against brute force."""

import __spark_entry__ as entry

QUERIES = entry.queries()

SF = "/root/testdata/sf0.001"


def test_routes_of_all_orders(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    region, nation = dict(read("nation", "n_nationkey", "n_regionkey")), dict(read("customer", "c_custkey", "c_nationkey"))
    want = []
    for o, c in read("orders", "o_orderkey", "o_custkey"):
        n = nation[c]
        want += [(f"o{o}", f"n{n}", f"s:c{c}/s:o{o}", 1), (f"o{o}", f"r{region[n]}", f"s:n{n}/s:c{c}/s:o{o}", 2)]
    got = [tuple(r) for r in QUERIES["routes_to_files"](spark, SF).select("doc_id", "path", "selectors", "nth").collect()]
    assert sorted(got) == sorted(want)


def test_slices_of_all_documents(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["byte_slice_whole"](spark, SF).collect()
    assert all(r["slice"].encode() == texts[r["doc_id"]][r["start_byte"] : r["end_byte"]] for r in got)
    assert {r["doc_id"] for r in got} == {i for i, t in texts.items() if t.strip()}
    assert any(len(t) > len(t.decode()) for t in texts.values()) and max(r["start_byte"] for r in got) > 64
    for i, t in texts.items():
        at = sorted((r["start_byte"], r["end_byte"]) for r in got if r["doc_id"] == i)
        assert all(not t[a:b].strip() for (_, a), (b, _) in zip(at, at[1:], strict=False)) and (not at or not t[: at[0][0]].strip() and not t[max(b for _, b in at) :].strip())
