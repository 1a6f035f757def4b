"""The entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split("NAMES")[1].split())


def test_everything_else_works_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert names(tmp_path) == {n for n in names(ROOT) if not n.startswith("op") and n != "pipeline"}


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_flagship(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "sentence", "ordinal", "pronoun", "pronoun_type", "antecedent"] and df.count() > 0


def canonical(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    return v


def catalogue_names():
    from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES

    return sorted(QUERIES), ORACLE_SQL


@pytest.mark.parametrize("name", catalogue_names()[0])
def test_catalogue_agrees_with_sql(spark, small, duck, name):
    from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        key = sorted(columns)
        want = sorted(([canonical(x[columns.index(c)]) for c in key] for x in r.fetchall()), key=repr)
        assert sorted(([canonical(x[c]) for c in key] for x in rows), key=repr) == want
