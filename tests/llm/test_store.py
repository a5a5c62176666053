"""Bounds on what the JVM and Python hold of a table at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import tidy
from tonegauge.llm.store import BATCH_BYTES, small_batches


def test_batches_of_long_texts_are_small(spark):
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(x) for x in names]
    try:
        small_batches(spark)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

        texts = spark.range(0, 60, 1, 1).select(F.expr("repeat('x', CAST(IF(id = 30, 9000000, 500000) AS INT))").alias("text"))
        got = [(r.rows, r.bytes) for r in texts.mapInArrow(tidy(run), "rows long, bytes long").collect()]
        assert sum(n for n, _ in got) == 60  # every row, long ones too
        assert max(b for n, b in got if b < 9_000_000) < BATCH_BYTES + 2 * 500_000
        spark.conf.set(names[1], "1m")
        small_batches(spark)
        assert spark.conf.get(names[1]) == "1m"  # a smaller bound stays
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
