"""Results do not depend on partitioning or row order."""

import pytest

from contrapair.plans import catalog
from tests.oracle import normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["flagship_lean_report", "e12_auc", "d11_nearest_reference", "f4_monte_carlo_two_sample", "g10_job_activity"])
def test_same_for_any_partition_count(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = catalog.queries()[name](spark, SF)
            seen.add(str(normal(df.columns, [tuple(r) for r in df.collect()])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
