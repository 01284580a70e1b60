"""All pairs by blocks: the same order as the SQL's function, copies and multiples included."""

import numpy as np

from worktrace.operators import access


def test_order_is_that_of_the_sql(spark, duck):
    r = np.random.default_rng(2)
    some = r.normal(size=(60, 16))
    vectors = np.concatenate([some, some[:20], 3 * some[:20], some[:20] / 7, 0.1 * some[:5], np.zeros((2, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = duck.execute(
        "with v as (select unnest(?::bigint[]) as id, unnest(?::float[][]) as e), s as (select a.id as q, b.id, list_cosine_similarity(a.e::double[], b.e::double[]) as s "
        "from v a, v b where a.id <> b.id and list_sum(a.e) <> 0 and list_sum(b.e) <> 0), "
        "r as (select *, row_number() over (partition by q order by s desc, id) as rank from s) select q, id, s, rank from r where rank <= 5",
        [list(range(len(vectors))), vectors.tolist()],
    ).fetchall()
    for block, part in ((2000, 5000), (9, 11)):
        assert sorted(map(tuple, access.most_similar(df, df, 5, block, part).collect())) == sorted(want)


def test_pairs_are_compared_inside_tasks(spark):
    df = spark.range(30).selectExpr("id", "array(1.0D, cast(id as double)) as embedding")
    plan = access.most_similar(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
