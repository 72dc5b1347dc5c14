import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import DATA, assert_same
from tidemark.queries import QUERIES, SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_its_sql_gives(spark, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 86


def test_saturating_steps_over_large_ids(spark, tmp_path):
    """Ids whose step is past what a bigint holds, which the SQL's own product can't be asked for."""
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(3).withColumn("event_id", F.element_at(F.array(F.lit(92_233), F.lit(92_234), F.lit(2**62)), F.row_number().over(Window.orderBy("event_id"))))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq: (r.up, r.down) for r in QUERIES["i9_saturating"](spark, str(tmp_path)).collect()}
    assert got[92_233][0] < 2**63 - 1 and got[92_234] == got[2**62] == (2**63 - 1, 0)
