"""Every pass over a source stands on the curriculum."""

import pytest

from lodeworks.llm import mixing


def test_passes_fill_the_whole_schedule(spark):
    rows = [(n, "w " * 10, "big") for n in range(400)] + [(1000 + n, "w " * 10, "small") for n in range(30)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    args = {"weights": (1, 5), "schedules": ((1.0, 1.0), (1.5, 0.5)), "max_repeat": 3}
    once = {r["doc_id"]: r for r in mixing.mix(t, **args).collect()}
    got = mixing.mix(t, by_pass=True, **args).collect()
    small = [r for r in got if r["doc_id"] >= 1000]
    assert len(small) == 90 and {r["nth_pass"] for r in small} == {1, 2, 3}
    for i, r in once.items():
        mine = [x for x in got if x["doc_id"] == i]
        assert sum(x["taken"] for x in mine) == r["taken"] and min((x["position"] for x in mine if x["taken"]), default=None) == r["position"]
    # At a row's position all sources together have met that share of their demand.
    ends = {"big": ((1.0, 1.0), 4300 - 900), "small": ((1.5, 0.5), 900)}
    for n, r in enumerate(sorted(small, key=lambda x: x["position"])):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if 1.5 * t - 0.5 * t * t < n / 90 else (lo, t)
        asked = sum(words * (a * lo + (b - a) * lo * lo / 2) / ((a + b) / 2) for (a, b), words in ends.values())
        assert r["position"] == pytest.approx(asked / 4300, abs=1e-6)
    assert [r["position"] for r in got if r["taken"]] == sorted(r["position"] for r in got if r["taken"])


def test_words_come_in_order_of_position(spark):
    """Of all words the mix takes, as many stand before a row as its position says, but for a document of each source."""
    rows = [(n, "w " * (n % 7 + 1), f"s{n % 3}") for n in range(3000)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), by_pass=True).collect() if r["taken"]]
    total, before = sum(r["taken"] for r in got), 0
    for r in got:
        assert abs(before / total - r["position"]) < 30 / total
        before += r["taken"]


def test_rows_without_ids_are_spread(spark):
    t = spark.createDataFrame([(None, f"{n} words", "s") for n in range(500)], "doc_id long, text string, source string")
    got = mixing.mix(t).collect()
    assert len({r["position"] for r in got}) == 500 and all(r["taken"] == 2 and r["passes"].startswith("2:") for r in got)
