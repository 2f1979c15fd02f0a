"""Written tables: whose they are, and that none is left behind."""

import subprocess
import sys
import threading
from pathlib import Path

from conftest import ROOT
from sieveline.sources import tables


def test_a_thread_deletes_its_own_tables_only(spark):
    since, other = tables.mark(), []
    first = tables.written(spark.range(3))
    thread = threading.Thread(target=lambda: other.append(tables.written(spark.range(5))))
    thread.start(), thread.join()
    last = tables.written(first.selectExpr("id + 1 as id"))
    paths = [Path(df.inputFiles()[0].removeprefix("file:")).parent for df in (first, other[0], last)]
    tables.only_last(since)
    assert [p.exists() for p in paths] == [False, True, True]
    assert other[0].count() == 5 and sorted(r.id for r in last.collect()) == [1, 2, 3] and tables.mark() == since + 1


def test_a_stopped_session_leaves_no_table(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from sieveline.sources import tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
paths = [tables.written(spark.range(3)).inputFiles()[0] for _ in range(3)]
spark.stop()
print(len(set(paths)))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.strip() == "3" and not list(tmp_path.rglob("table-*"))
