"""What a Python worker is sent at once is bounded by rows and by bytes, however large tables are."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import packages
from stemma.sources import storage


@pytest.mark.parametrize("begin", [lambda s, d: T.nfkc(F.col("text")), lambda s, d: packages.facts(s.createDataFrame([], "archive string, member string, content binary")), lambda s, d: storage.read_archives(s, str(d))])
def test_batches_are_bounded(spark, tmp_path, begin):
    """F11 to F15."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for k in keys:
        spark.conf.unset(k)
    begin(spark, tmp_path)

    @F.pandas_udf("struct<rows:long,chars:long>")
    def seen(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(s)] * len(s), "chars": [int(s.str.len().sum())] * len(s)})

    most = lambda n, text: spark.range(0, n, 1, 1).select(seen(F.repeat(F.lit("x"), text)).alias("b")).agg(F.max("b.rows"), F.max("b.chars")).first()
    assert most(5000, 1)[0] <= T.BATCH_ROWS and most(60, 1 << 20)[1] <= T.BATCH_BYTES + (2 << 20)
    spark.conf.set(keys[0], "50")
    begin(spark, tmp_path)
    assert spark.conf.get(keys[0]) == "50"
    spark.conf.unset(keys[0])
