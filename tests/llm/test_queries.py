from __future__ import annotations

import re

from topoeval.llm import queries


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == [*range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts[len(root.parts) :]:
            assert "topoeval.llm" not in f.read_text(), f
