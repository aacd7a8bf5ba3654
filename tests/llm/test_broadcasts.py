from lodestone.llm.common import written
from lodestone.llm.pivots import of_checked_size


def test_only_small_tables_are_broadcast(spark):
    plan = lambda n: of_checked_size(written(spark.range(n).selectExpr("id", "id AS n"), "sized"))._jdf.queryExecution().logical().toString()
    # in bytes about 0.06 and 2.2 million: what a tenth of a GB shuffles has to be shuffled there, as it is at half of one
    assert "broadcast" in plan(1000).lower()
    assert "broadcast" not in plan(40_000).lower()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        assert "broadcast" not in plan(1000).lower()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
