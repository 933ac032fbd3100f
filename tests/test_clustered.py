"""Pages from clustered files against sorting all messages, and the files that they read."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import clustered, mailbox
from lodeworks.operators.clustered import PageStore

SCHEMA = "doc_id long, sent_at timestamp, subject string"


def messages(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else datetime(2025, 1, 1) + timedelta(hours=rng.randrange(n // 3)), f"s{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("newest", [True, False])
def test_pages_one_after_the_other(spark, tmp_path, newest):
    m = messages(spark, 200)
    store = PageStore.build(m, f"file://{tmp_path}/p", rows=30)
    for where in (lambda t: t, lambda t: t.filter("subject = 's3'")):
        want = [tuple(r) for r in where(m).orderBy(*mailbox.page_order(newest)).collect()]
        got, after = [], None
        while True:
            rows = store.page(after=after, newest=newest, limit=23, where=where)
            got += [tuple(r) for r in rows[:23]]
            if len(rows) <= 23:
                break
            after = (rows[22]["sent_at"], rows[22]["doc_id"])
        assert got == want


def test_files_read_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    read = []
    for n in (300, 1500):
        store = PageStore.build(messages(spark, n), f"file://{tmp_path}/p{n}", rows=50)
        opened = []
        monkeypatch.setattr(PageStore, "files", lambda self, after, newest, real=PageStore.files, opened=opened: (opened.extend(g) or g for g in real(self, after, newest)))
        middle = store.page(after=(datetime(2025, 1, 1) + timedelta(hours=n // 6), 0), limit=10)
        assert len(middle) == 11
        read.append(len(opened))
        monkeypatch.undo()
    assert max(read) <= 3


def test_nothing_and_found_again(spark, tmp_path):
    m = messages(spark, 20)
    assert PageStore.build(m.limit(0), f"file://{tmp_path}/none").page() == []
    m.write.parquet(f"file://{tmp_path}/m")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/m")
    assert PageStore.build(read()).path == PageStore.build(read()).path != PageStore.build(read().filter(F.col("doc_id") > 3)).path
    assert clustered.PageStore.build(read()).page(limit=100) == m.orderBy(*mailbox.page_order()).collect()


def test_places_in_mailboxes(spark, monkeypatch):
    """One mailbox with most rows, one without a name, ties."""
    rng = random.Random(8)
    rows = [(i % 190, rng.choice([None, datetime(2025, 1, 1 + rng.randrange(3))]), rng.choice(["big"] * 8 + ["small", None])) for i in range(200)]
    m = spark.createDataFrame(rows, "doc_id long, sent_at timestamp, box string")
    got = sorted(map(tuple, mailbox.numbered(m, by="box", size=7).select("box", "place", "page", "sent_at", "doc_id", "reading").collect()), key=str)
    want = []
    for box in {b for *_, b in rows}:
        own = [(t, i) for i, t, b in rows if b == box]
        newest = sorted(own, key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0].timestamp(), r[1]), reverse=True)
        want += [(box, n, (n - 1) // 7 + 1, t, i) for n, (t, i) in enumerate(newest, 1)]
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    for box in {b for *_, b in rows}:
        order = [(r[3], r[4]) for r in sorted((r for r in got if r[0] == box), key=lambda r: r[5])]
        assert order == sorted(order, key=lambda r: (r[0] is None, 0 if r[0] is None else r[0].timestamp(), r[1])) and sorted(r[5] for r in got if r[0] == box) == list(range(1, len(order) + 1))
