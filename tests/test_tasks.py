"""How much the tasks of a job hand on, and over how many tasks rows are spread."""

from uttermark.functions import text as X
from uttermark.operators import models as M
from uttermark.plans import fixtures


def test_sums_of_all_cells_are_handed_on_once():
    """A task with every cell of the design keeps its sums, and doesn't hand them on after each batch."""
    assert 209 * (len(M.CELL_VALUES) + 2) * 2000 * 8 < M.HELD_BYTES


def test_turns_of_one_file_are_spread(spark):
    rows = fixtures.text_rows(spark, "/root/testdata/sf0.001")
    assert len({r["p"] for r in rows.selectExpr("spark_partition_id() p").distinct().collect()}) > 1
    some = spark.createDataFrame([("a b", "a b"), ("a b", "a c"), ("a", "")], "r string, h string")
    assert [r[0] for r in some.select(X.cer(some.r, some.h)).collect()] == [0.0, 1 / 3, 1.0]
