import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_one_row_per_conversation(spark):
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert entry.entry(spark).count() == conversations.select("conv_id").distinct().count()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, name):
    verdict, _ = check.compare(spark, name, FOLDER)
    assert not verdict.startswith("FAIL"), verdict
