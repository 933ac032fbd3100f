"""Vectors that are kept, told from those that are made: texts whose vector is nothing, texts that are missing."""

import pandas as pd

from lodeworks.plans import rows


def test_vectors_without_length_are_not_taken_for_kept_ones(spark, tmp_path):
    # No words; two words that cancel; a text that stands on both sides; one known before.
    texts = [(1, " "), (3, "b d"), (3, "both"), (2, "both"), (4, "\t"), (2, "even"), (5, None)]
    pd.DataFrame(texts, columns=["conv_id", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = {r["raw_sha256"]: r["known"] for r in rows.embeddings_kept(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and None in got and not got[None]
    assert sorted(got.values()) == [False, False, True, True, True]


def test_all_texts_without_words_are_new_where_none_was_known(spark, tmp_path):
    pd.DataFrame([(1, " "), (3, "x")], columns=["conv_id", "text"]).to_parquet(tmp_path / "conversations.parquet")
    assert [r["known"] for r in rows.embeddings_kept(spark, str(tmp_path)).collect()] == [False, False]


def test_missing_texts_are_known_once(spark, tmp_path):
    pd.DataFrame([(1, None), (2, None), (4, "x")], columns=["conv_id", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = [(r["raw_sha256"] is None, r["known"]) for r in rows.embeddings_kept(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(False, True), (True, True)]
