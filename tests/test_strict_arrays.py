"""A second entry of any kind makes an answer more than one array, found without parsing it a third time."""

import inspect

from pyspark.sql import functions as F

from worktrace.operators import answers


def test_second_entries(spark):
    cases = {"[1]": True, "[]": True, "[[1],null]": True, "[1],null": False, "[1], [2]": False, "[1],\"a\",[2]": False, "[1]],[[2]": False, "[1]},{[2]": False, "[1] x []": False}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", answers.is_one_array(F.col("x"))).collect()} == cases
    assert "from_json" not in inspect.getsource(answers.is_one_array)
