import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "validate" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    for p in ROOT.glob("wavespan/**/*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p
