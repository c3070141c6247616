import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check import TABLES, difference
from verification.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def short_documents(spark, tmp_path):
    """Contigs of no, one, two, three and sixty bases."""
    texts = [(0, "a"), (1, "xy."), (2, "abc"), (3, "0 1"), (4, "the quick brown fox " * 4)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_sequences_without_a_whole_codon_have_no_protein(spark, short_documents):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{short_documents}/documents.parquet/*.parquet'")
    for table in set(TABLES.split()) - {"documents"}:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = contract.queries()["translate_cds"](spark, short_documents).toPandas()
    assert sorted(ours["transcript_id"]) == ["in2", "in4", "tx4"]
    assert difference(ours, connection.execute(contract.oracle_sql()["translate_cds"]).fetch_df()) is None


def test_regions_go_through_the_texts_once(spark, short_documents):
    fixtures = Fixtures(spark, short_documents)
    for _ in range(2):
        plan = fixtures.regions()._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "Relation" in plan
    assert fixtures.regions().count() == 6
