"""How many rows the steps of a plan make, for tests of what grows with what."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def most_rows(spark: SparkSession, run: Callable[[], DataFrame]) -> int:
    """The most rows that any step makes, of all plans that ``run`` and the reading of its result start."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, every = 0, store.executionsList()
    for n in range(before, every.size()):
        at = every.apply(n).executionId()
        told, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                m = metrics.apply(j)
                if m.name() == "number of output rows" and told.contains(m.accumulatorId()):
                    most = max(most, int(told.apply(m.accumulatorId()).replace(",", "")))
    return most
