from verification.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_pieces_are_read_by_all_cores_without_a_shuffle(spark):
    pieces = Fixtures(spark, SF).pieces()
    assert "Repartition" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    assert pieces.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
