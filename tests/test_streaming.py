"""Kinds of versions that arrive in batches, against those of all rows at once."""

import random

import pytest

from sentrel.operators.quality import classified
from sentrel.streaming import kinds, upsert

SCHEMA = "report_id string, version long, page string, index long"


def test_kinds_do_not_depend_on_the_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"r{r.randint(0, 12)}", r.choice([None, 1, 1, 2, 3]), f"p{i // 10:03d}", i % 10) for i in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, classified(table, "report_id", "version", ["page", "index"]).select("report_id", "page", "index", "kind").collect()))
    for cut in ((40, 41, 90), (60,)):
        place = tmp_path / f"in{len(cut)}"
        for n, (lo, hi) in enumerate(zip((0, *cut), (*cut, 120), strict=True)):
            spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.parquet(str(place / f"n={n}"))
        stream = spark.readStream.schema(SCHEMA + ", n int").option("maxFilesPerTrigger", 1).parquet(str(place))
        with pytest.raises(ValueError, match="providerClass"):
            kinds.told(stream)
        spark.conf.set(*kinds.PROVIDER)
        try:
            run = kinds.told(stream).writeStream.format("parquet").option("path", str(place) + "-out").option("checkpointLocation", str(place) + "-check").trigger(availableNow=True).start()
            run.awaitTermination()
        finally:
            spark.conf.unset(kinds.PROVIDER[0])
        assert run.lastProgress["batchId"] == len(cut)
        assert sorted(map(tuple, spark.read.parquet(str(place) + "-out").select("report_id", "page", "index", "kind").collect())) == want


def test_a_table_without_batches_is_empty(spark, tmp_path):
    assert upsert.current(spark, str(tmp_path / "none")).count() == 0
