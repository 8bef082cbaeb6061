"""What the largest task of a query reads in a shuffle, as Spark's own task metrics have it."""

import numpy as np
import pandas as pd
import pytest

from plumbline import catalog


def largest_read(spark, run):
    """Bytes that the largest task read from shuffles while run() ran."""
    context = spark.sparkContext._jsc.sc()
    store, as_list = context.statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    stages = lambda: {s.stageId(): s for s in as_list(store.stageList(*[getattr(store, f"stageList$default${i}")() if i > 1 else None for i in range(1, 6)]))}
    context.listenerBus().waitUntilEmpty()
    known = set(stages())
    run()
    context.listenerBus().waitUntilEmpty()
    most = 0
    for stage_id in set(stages()) - known:
        for task in as_list(store.taskList(stage_id, 0, 1000)):
            if task.taskMetrics().isDefined():
                read = task.taskMetrics().get().shuffleReadMetrics()
                most = max(most, read.localBytesRead() + read.remoteBytesRead())
    return most


@pytest.mark.parametrize("name", ["box_plots", "scaling_rules"])
def test_a_task_reads_bins_and_not_values(spark, tmp_path, name):
    """All prices are distinct: eight times the rows may not make the largest task read eight times as much."""
    reads = []
    for n in (40_000, 320_000):
        rng, folder = np.random.default_rng(n), tmp_path / str(n)
        folder.mkdir()
        table = {"l_quantity": rng.integers(1, 51, n), "l_extendedprice": rng.permutation(n) + 0.5, "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100}
        pd.DataFrame(table).astype(float).to_parquet(folder / "lineitem.parquet")
        reads.append(largest_read(spark, lambda folder=folder: catalog.queries()[name](spark, str(folder)).collect()))
    assert 0 < reads[1] < 2 * reads[0], reads
