"""Rows of one file meet in one task, however Spark coalesces the partitions that they come from."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_oracle import rows_of

from loomspan.operators import graph
from loomspan.plans import queries  # noqa: F401  registers the queries
from loomspan.plans.registry import ORACLES, QUERIES

SMALL = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}


@pytest.fixture
def coalesced(spark):
    """Partitions are coalesced to so few bytes that a small table has several."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_links_of_a_union_meet(coalesced):
    """Both parts lie by file, the second one in fewer partitions."""

    def lying(rows):
        n = F.row_number().over(Window.partitionBy("file").orderBy("a"))
        return coalesced.createDataFrame(rows, "file long, a long, b long").withColumn("n", n).where("n > 0").drop("n")

    many = lying([(f, 2 * i, 2 * i + 1) for f in range(40) for i in range(300)])
    got = graph.components_by_file(many.unionByName(lying([(f, 1, 2) for f in range(40)]))).collect()
    want = [(f, i, 0 if i < 4 else i - i % 2) for f in range(40) for i in range(600)]
    assert sorted((r.file, r.node, r.root) for r in got) == want


@pytest.mark.parametrize("name", ["exp04_agg21_confidence", "itr01_itr02_win11_roles", "scf24_exp02_marks"])
def test_query_of_sets(coalesced, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](coalesced, sf)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
