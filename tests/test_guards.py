import pytest
from pyspark.sql import functions as F

from lodeworks.operators import guards


def test_requests():
    assert guards.mailbox_address("Ada <ADA@X.org>") == "ada@x.org" and guards.domain_name("@X-y.Org") == "x-y.org"
    for bad in ("a", "a@b, c@d", "a b@c", "x" * 330 + "@y.z"):
        with pytest.raises(ValueError):
            guards.mailbox_address(bad)
    for bad in ("-a.org", "a..b", "é.org", "a" * 64 + ".org"):
        with pytest.raises(ValueError):
            guards.domain_name(bad)
    assert guards.moment("2024-02-03").hour == 0 and guards.moment("2024-02-03T10:00:00+01:00").hour == 10
    with pytest.raises(ValueError):
        guards.moment("2024-02-03T10:00:00")
    assert guards.readable("a1") and guards.readable("éé") and not guards.readable("a 1 .")


def test_scope_readiness_lock_and_counts(spark):
    meta = spark.createDataFrame([("w", "m", 64)], "workspace_id string, embed_model string, embed_dim int")
    guards.in_scope(meta, "w", "m", 64)
    for who in (("x", "m", 64), ("w", "m", 32)):
        with pytest.raises(RuntimeError):
            guards.in_scope(meta, *who)
    assert guards.readiness({"a": meta, "b": meta.limit(0)}, {"a": ("embed_dim", "q"), "b": ("embed_dim",), "c": ()}) == ["a: no q", "b: empty", "c: missing"]
    with guards.exclusive(spark, "w"):
        with pytest.raises(RuntimeError):
            with guards.exclusive(spark, "w"):
                pass
    with guards.exclusive(spark, "w"):
        pass
    df, seen = guards.counted(spark.range(10), "n", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}
