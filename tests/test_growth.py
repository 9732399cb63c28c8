"""What must not grow with an image: the work done twice, and the copies that a task holds of a batch."""

import tracemalloc

import pyarrow as pa

from voxspark.jobs import catalog
from voxspark.operators.tiles import buffers


def test_cubes_are_exchanged_twice_and_worked_out_once(spark, sf):
    _, smooth, moving, kept = catalog.smooth_pair(spark, sf)
    with catalog.freed(kept):
        made = kept._jdf.queryExecution().executedPlan().toString()
        assert made.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
        for image in (smooth, moving):
            assert "InMemoryTableScan" in image._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, smooth.collect())) == sorted(map(tuple, catalog.QUERIES["smooth_volume"](spark, sf).collect()))


def test_blocks_of_a_batch_are_copied_one_at_a_time():
    column = pa.array([b"a" * (1 << 20), None, *[b"b" * (1 << 20)] * 30])
    tracemalloc.start()
    held, none = pa.total_allocated_bytes(), 0
    for block in buffers(column):
        none += block is None
        assert block is None or block.size == 1 << 20
        assert pa.total_allocated_bytes() - held < 4 << 20
    assert none == 1 and tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def exchanged(df):
    """Rows and bytes that the exchanges of a query that has run have written."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name, metrics = node.getClass().getSimpleName(), node.metrics()
        if name == "ShuffleExchangeExec":
            found.append([metrics.apply(m).value() for m in ("shuffleRecordsWritten", "shuffleBytesWritten")])
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return [sum(v) for v in zip(*found, strict=True)]


def test_candidates_exchange_tiles_and_no_row_by_voxel(spark, sf):
    df = catalog.QUERIES["lcc_candidates"](spark, sf)
    assert len(df.collect()) == len(catalog.SHIFTS)
    rows, size = exchanged(df)
    assert rows < 1000 and size < 10 * 32000
