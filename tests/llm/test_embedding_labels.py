"""Labels of any type group vectors as they are."""

import pytest

from brindle.llm import embedding_dedup

V, W = [1.0, 0.0], [0.0, 1.0]


@pytest.mark.parametrize("kind,labels", [("string", ["a", "b", "7"]), ("double", [1.2, 1.9, 2.5]), ("date", None)])
def test_labels_of_any_type(spark, kind, labels):
    import datetime

    a, b, c = labels or [datetime.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, V, a), (2, V, b), (3, [1.0, 0.1], a), (4, W, a), (5, W, c), (6, V, None), (7, [0.1, 1.0], c)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert out == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (1, 5), 6: (0, 6), 7: (1, 5)}
