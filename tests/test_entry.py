import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_catalogue_and_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)
    assert {f"p{n}_found" for n in range(1, 6)} <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["address", "owner", "tick_lower", "tick_upper", "opened_transaction_hash", "opened_log_index"]


def test_nothing_outside_imports_the_document_subpackage():
    for path in (ROOT / "tidebook").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("tidebook.llm" in n for n in names), path
