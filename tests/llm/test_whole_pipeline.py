"""The pipeline against plain Python, its stages on hard rows, and its tables."""

import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from lodeworks.llm import common
from tests.llm.test_small import repeat_words
from tests.llm.test_tables import classes

SF = "/root/testdata/sf0.001"


def quality(docs):
    """Texts by id after frequent lines and rejected documents are gone."""
    shape = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    spoken = lambda x: re.search(r"[^\x20\x09-\x0D]", x)
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    holders, every = defaultdict(set), defaultdict(set)
    for text, source in docs.values():
        if own := frozenset(shape(x) for x in text.split("\n") if spoken(x)):
            every[source].add(own)
            for x in own:
                holders[source, x].add(own)
    frequent = {k for k, v in holders.items() if len(v) > 5 and len(v) * 100 > len(every[k[0]]) * 10}
    out = {}
    for i, (text, source) in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [x for x in text.split("\n") if spoken(x) and (source, shape(x)) in frequent]
        left = len(words) - sum(map(count, gone))
        depleted = gone and (left < 10 or left < len(words) * 0.3)
        if len(words) >= 10 and 100 * repeat_words(" ".join(words)) <= 20 * len(words) and not depleted:
            out[i] = "\n".join(x for x in text.split("\n") if not (spoken(x) and (source, shape(x)) in frequent))
    return out


def contaminated(texts, items):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = set()
    for t in items:
        w = word.findall((t or "").encode().lower())
        size = min(10, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    sizes = {len(x) for x in windows}
    split = {i: word.findall(t.encode().lower()) for i, t in texts.items()}
    return {i for i, w in split.items() if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}


def test_equal_to_plain_python(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = quality({i: (r["text"] or "", r["source"]) for i, r in rows.items()})
    texts = {i: t for i, t in texts.items() if classes(texts)[i][0] == i}
    leaks = contaminated(texts, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    texts = {i: t for i, t in texts.items() if i not in leaks}
    assert len(rows) > len(texts) > 50 and leaks
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    want = spark.createDataFrame([(rows[i]["doc_id"], t, rows[i]["lang"], rows[i]["source"], rows[i]["n_chars"]) for i, t in texts.items()], schema)
    for _, stage in corpus_pipeline.STAGES[3:]:
        want = stage(spark, want, SF)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    got, want = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str)
    assert got == want
    assert all(len(r[1]) == r[4] for r in got)


TEXTS = [None, "", " \n\t ", "a", *["one two three four five six seven eight nine ten eleven twelve"] * 3, "lorem ipsum dolor sit amet consectetur " * 2, "word " + " ".join(f"w{i}" for i in range(20_000)), "mail joe@example.com or call +1 555 123 4567 today, as we have said many times before", "é ü ñ 漢字 \U0001f600 words are words too, ten of them at the very least here"]
IDS = [1, 2, 3, 4, 5, 5, 6, 7, 8, None, 9]


@pytest.mark.parametrize("extra", ("taken long, position string, _row int, nth_pass int, _key int, _id int, node int", "n_chars long, passes string, spans string, found int, row int, __key int, _gone_lines int"))
def test_stages_on_hard_rows_and_empty_tables(spark, extra):
    names = [x.split()[0] for x in extra.split(", ")]
    rows = [(i, t, None if n % 4 == 0 else "s", *[str(n) if c in ("position", "passes", "spans") else n for c in names]) for n, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}")
    seen = []
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            if name != "mixing":
                assert out.columns == docs.columns
            data = common.stored(out, "stage-test")
            seen.append({(r["doc_id"], r["text"]) for r in data.collect()})
    first, joined, clean, private, mixed = seen[:5]
    assert {i for i, _ in first} == {5, 6, 8, None, 9} and {i for i, _ in joined} == {5, 8, None, 9} and clean == joined
    assert ("@" not in str(private)) and {i for i, _ in private} == {5, 8, None, 9} and {i for i, _ in mixed} <= {5, 8, None, 9}
    assert seen[5:] == [set()] * 5


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, text, "s")] * 4 + [(None, text + " more", "s")] * 2, "doc_id long, text string, source string")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) in ([0], [5])


def test_scratch_tables_are_deleted(spark):
    with common.Scratch() as s:
        a = common.stored(spark.range(5), "a")
        with common.Scratch() as inner:
            b = common.stored(a, "b")
            c = inner.result(b, "c")
        local = lambda t: t._stored_at.removeprefix("file://")
        assert os.path.isdir(local(a)) and not os.path.isdir(local(b)) and c.count() == 5
        d = s.result(c, "d")
    assert d.count() == 5 and not os.path.isdir(local(a)) and not os.path.isdir(local(c))


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Nothing:
        master = "spark://elsewhere"
        conf = property(lambda self: self)
        sparkContext = property(lambda self: self)

        def get(self, *_):
            return None

        def getConf(self):
            return self

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Nothing())
