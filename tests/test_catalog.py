"""Every inventory row has a query; headline queries equal their SQL twins on the smallest data."""

import subprocess
import sys
from pathlib import Path

import pytest

import check
import inventory_coverage
from bench import HEADLINE
from stipple.catalog import load

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"


def test_every_inventory_row_is_covered():
    assert inventory_coverage.inventory() <= inventory_coverage.covered()


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", HEADLINE[::2])  # tools/check.py runs them all
def test_equals_sql(spark, name):
    import __spark_entry__ as entry

    n, ok, note = check.compare(entry.queries()[name], load()[name].sql, spark, FOLDER, check.connect(FOLDER))
    assert ok, note
