"""Hands whose numbers round to zero."""

from pyspark.sql import functions as F

from worktrace.functions import hands


def test_zeros_keep_their_sign(spark):
    values = [-0.00004, 0.00004, -0.0, 0.0, -0.00005, 0.12345, None]
    df = spark.createDataFrame([([[v, 0.5] for v in values],)], "p array<array<double>>")
    row = df.select(F.to_json(F.struct(hands.rounded(F.col("p")).alias("p")))).first()[0]
    assert row == '{"p":[[-0.0,0.5],[0.0,0.5],[-0.0,0.5],[0.0,0.5],[-1.0E-4,0.5],[0.1235,0.5],[null,0.5]]}'
    df = spark.createDataFrame([([[-0.0002, 0.0001], [0.0001, -0.00005]],)], "p array<array<double>>")
    row = df.select(F.to_json(hands.summary(F.col("p")))).first()[0]
    assert row == '{"wrist_xy":[-2.0E-4,1.0E-4],"mean_x":-1.0E-4,"mean_y":0.0,"landmark_count":2}'
    df = spark.createDataFrame([([[-0.0001, 0.0], [0.00005, 0.0]],)], "p array<array<double>>")
    assert df.select(F.to_json(hands.summary(F.col("p")))).first()[0].startswith('{"wrist_xy":[-1.0E-4,0.0],"mean_x":-0.0,"mean_y":0.0')
