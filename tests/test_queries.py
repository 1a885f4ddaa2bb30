"""Every query of the library against its SQL, at the smallest size; those without SQL must run."""

import pytest
from oracle import DATA, both, views

from plumbline.queries import ORACLE_SQL, QUERIES

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    ours, theirs = both(spark, con, QUERIES[name], ORACLE_SQL[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_main_library_does_not_import_corpus_operators():
    import ast
    from pathlib import Path

    for path in Path("plumbline").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("plumbline.llm" in n or n == "corpus_pipeline" for n in names), path
