"""Tables in the shared folder."""

import os

from lodestone.llm import common


def test_tables_are_written_discarded_and_swept(spark):
    a = common.materialize(spark.range(5), "a")
    b = common.materialize(spark.range(3), "b")
    assert a.count() == 5 and b.count() == 3 and os.path.isdir(a._written_at)
    common.discard(a)
    assert not os.path.exists(a._written_at) and b.count() == 3
    common.sweep(spark)
    assert not os.path.exists(b._written_at) and not common._written


def test_pieces_hold_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 100] * 1000)], ["i", "t"])
    got = list(common.pieces(b, 10_000))
    assert len(got) > 5 and [i for p in got for i in p.column(0).to_pylist()] == list(range(1000))
    assert list(common.pieces(b.slice(0, 0))) == [] and [p.num_rows for p in common.pieces(b, 1)] == [1] * 1000
