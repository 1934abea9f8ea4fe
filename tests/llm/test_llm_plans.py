"""Properties of the final plans, and independence of partitioning and of where a job is started."""

import os
import subprocess
import sys

import pytest

from quarry.llm import catalogue, common, linededup, sharding, simhash
from quarry.llm.common import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_simhash", "op3_language_id", "op5_line_dedup", "op7_label_propagation", "op10_secrets"])
def test_no_cross_joins(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    if name.startswith("op7"):
        assert not any(x in p for x in ("Python", "Pandas", "Arrow"))


def test_only_the_needed_columns_are_read(spark):
    p = plan(catalogue.QUERIES["op10_secrets"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_windows_stay_in_the_jvm(spark):
    assert not any(x in plan(linededup.covered(table(spark, SF, "documents"))) for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [1, 13])
def test_results_do_not_depend_on_partitions(spark, n):
    docs = table(spark, SF, "documents")
    dealt = docs.repartition(n, "lang")
    for fn in (linededup.report, simhash.report):
        assert sorted(map(tuple, fn(docs).collect())) == sorted(map(tuple, fn(dealt).collect()))
    sizes = {}
    for r in sharding.report(dealt).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_written_tables_live_in_the_shared_folder(spark):
    df = common.written(spark.range(5), "probe")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert df._scratch.startswith(base) and df.count() == 5
    common.discard(df)
    assert not os.path.exists(df._scratch.removeprefix("file:"))


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from quarry.session import get_session\n"
            "import __spark_entry__ as E\n"
            f"print('ROWS', E.queries()['op10_secrets'](get_session('local[2]', 2), {SF!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 200" in said.stdout, said.stderr[-800:]
