from tabloom.session import narrow_rows, tune_session

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_only_batches_that_cannot_reach_the_limit_go_without(spark):
    tune_session(spark)
    before = spark.conf.get(LIMIT)
    with narrow_rows(spark, 100):
        assert spark.conf.get(LIMIT) == str(2**31 - 1)
    assert spark.conf.get(LIMIT) == before
    with narrow_rows(spark, 1000):
        assert spark.conf.get(LIMIT) == before
