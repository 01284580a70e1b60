"""What the index search holds and ships at a time."""

import numpy as np
import pyarrow as pa

from worktrace.operators import vector_index


def test_batches_of_probes_are_bounded():
    r = np.random.default_rng(1)
    cells = vector_index._Cells([{"cell": i, "parts": [i], "centroid": c, "least": 0.1, "scale": 0.01} for i, c in enumerate(r.normal(size=(600, 8)))])
    queries = r.normal(size=(300, 8))
    batch = pa.record_batch([pa.array(range(300)), pa.array(queries.tolist()), pa.array([-2.0] * 300)], ["query_id", "embedding", "least"])
    out = list(vector_index._probed(cells, None)(iter([batch])))
    assert sum(b.num_rows for b in out) == 300 * 600 and max(b.num_rows for b in out) <= vector_index.PROBE_ROWS


def test_small_cells_are_not_split(spark, tmp_path, monkeypatch):
    vectors = np.random.default_rng(2).normal(size=(900, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    monkeypatch.setattr(vector_index, "PART_ROWS", 200)
    vector_index.build(rows, f"file://{tmp_path}/index", cells=20)
    assert spark.read.parquet(f"file://{tmp_path}/index/entries").select("cell", "part").distinct().count() == 20
