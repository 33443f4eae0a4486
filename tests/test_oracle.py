"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from millrace.operators import metrics
from millrace.plans import catalog
from millrace.plans.views import Tables
from oracle_check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, connection, name):
    rows = QUERIES[name](spark, SF_DIR).toArrow()
    assert compare(rows, connection.sql(ORACLES[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_is_the_flagship(spark):
    result = entry.entry(spark)
    assert {"id", "total", "progress", "duration_seconds"} <= set(result.columns)


def test_approximate_quantiles_are_close(spark):
    exact = QUERIES["metric_summary"](spark, SF_DIR).toPandas()
    samples = Tables(spark, SF_DIR).metric_samples
    rough = metrics.summary_accuracy(samples, ["label_type"], [0.5, 0.9, 0.99]).toPandas()
    values = samples.select("label_type", "value").toPandas().groupby("label_type")["value"]
    for r in rough.itertuples():
        group = values.get_group(r.label_type)
        assert (r.n, r.below, r.upto) == (len(group), (group < r.value).sum(), (group <= r.value).sum()) and r.within
    both = exact.merge(rough, on=["metric", "label_type", "quantile"])
    assert len(both) == len(exact)
    medians = both[both["quantile"] == 0.5]
    assert ((medians["value_x"] - medians["value_y"]).abs() <= 0.2 * medians["value_x"]).all()


def test_inventory_lists_the_data_files(spark):
    rows = QUERIES["file_inventory"](spark, SF_DIR).toPandas()
    assert set(rows["name"]) == set(os.listdir(SF_DIR))
    sizes = {n: os.path.getsize(f"{SF_DIR}/{n}") for n in rows["name"]}
    assert dict(zip(rows["name"], rows["size"])) == sizes
    assert set(rows["extension"]) == {".parquet"}
