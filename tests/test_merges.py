"""Bucketed tables against plain dictionaries, and which files a merge leaves alone."""

import random
from datetime import datetime

import pytest
from pyspark.sql import types as T

from lodeworks.operators.merges import Bucketed, MailStore
from lodeworks.operators.tables import folders

ROWS = "k long, path string, v int, first_seen int"


def table(tmp_path, buckets=8):
    return Bucketed(f"file://{tmp_path}/t", T.StructType.fromDDL(ROWS), ("k", "path"), buckets)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_like_a_dictionary(spark, tmp_path, seed):
    rng, t, held = random.Random(seed), table(tmp_path), {}
    for step in range(4):
        key = lambda: (rng.choice([None, *range(12)]), rng.choice(["a", None]))
        batch = [(*key(), rng.randrange(100), step) for _ in range(8)]
        gone = [key() for _ in range(3)]
        named = {r[:2] for r in batch}
        gone = [g for g in gone if g not in named]
        t.merge(spark.createDataFrame(batch, ROWS), keep=["first_seen"], order=["v"], deleted=spark.createDataFrame(gone, "k long, path string"))
        for g in gone:
            held.pop(g, None)
        for r in sorted(batch, key=lambda r: r[2]):
            before = held.get(r[:2])
            held[r[:2]] = (*r[:3], step if before is None or before[3] == step else before[3])
        assert rows(t.read(spark)) == sorted(held.values(), key=str)
    want = sorted([v for k, v in held.items() if k[0] in (1, 2, None)], key=str)
    asked = spark.createDataFrame([(k, p) for k in (1, 2, None) for p in ("a", None)], "k long, path string")
    assert rows(t.lookup(asked)) == want


def test_other_buckets_keep_their_files(spark, tmp_path):
    t = table(tmp_path, 16)
    t.merge(spark.createDataFrame([(i, "a", i, 0) for i in range(200)], ROWS))
    before, files = t.current(spark), set(t.read(spark).inputFiles())
    made = t.merge(spark.createDataFrame([(3, "a", -1, 1)], ROWS))
    after = t.current(spark)
    assert len(made) == 1 and {b for b in after if after[b] != before[b]} == set(made) and len(files & set(t.read(spark).inputFiles())) == len(files) - 1
    # The version before can be read until it is swept.
    assert rows(t.read(spark, version=1)) == [(i, "a", i, 0) for i in sorted(range(200), key=lambda i: str((i, "a", i, 0)))]
    assert t.swept(spark) == 1 and t.read(spark).count() == 200 and folders(spark, f"{t.path}/manifest") == ["v2"]
    assert t.merge(spark.createDataFrame([], ROWS)) == {} and folders(spark, f"{t.path}/manifest") == ["v2"]


def test_a_merge_without_manifest_is_not_seen(spark, tmp_path):
    t = table(tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1, 0)], ROWS))
    spark.createDataFrame([(1, "a", 9, 0)], ROWS).write.parquet(f"{t.path}/data/lost/bucket=0")
    assert rows(t.read(spark)) == [(1, "a", 1, 0)] and t.swept(spark) == 1
    assert table(tmp_path / "none").read(spark).count() == 0 and table(tmp_path / "none").lookup(t.read(spark)).count() == 0


MAIL = "doc_id long, message_id string, subject string, sent_at timestamp, automated_class string, list_id string, ingested_at timestamp, addresses array<struct<kind:string,ordinal:int,address:string,display_name:string,valid:boolean>>, references array<string>"


def test_mail_that_comes_again(spark, tmp_path):
    store, day = MailStore.at(f"file://{tmp_path}/mail", 4), lambda n: datetime(2025, 1, n)
    mail = lambda i, subject, at, boxes, refs: (i, f"m{i}", subject, day(1), "human", "", at, [("from", n, b, "", True) for n, b in enumerate(boxes)], refs)
    store.save(spark.createDataFrame([mail(1, "old", day(2), ["a@x", "b@x"], ["r1", "r2"]), mail(2, "two", day(2), ["c@x"], [])], MAIL))
    store.save(spark.createDataFrame([mail(1, "new", day(9), ["z@x"], []), mail(3, "three", day(9), [], ["r3"])], MAIL))
    for _ in range(2):
        got = {r["doc_id"]: (r["subject"], r["ingested_at"]) for r in store.messages.read(spark).collect()}
        assert got == {1: ("new", day(2)), 2: ("two", day(2)), 3: ("three", day(9))}
        assert sorted((r["doc_id"], r["address"]) for r in store.addresses.read(spark).collect()) == [(1, "z@x"), (2, "c@x")]
        assert [(r["doc_id"], r["ordinal"], r["message_id"]) for r in store.references.read(spark).collect()] == [(3, 0, "r3")]
        store.save(spark.createDataFrame([mail(3, "three", day(10), [], ["r3"])], MAIL))
