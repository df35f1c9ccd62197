"""The entry module keeps the library's queries where the optional subpackage cannot be imported."""

import sys

import __spark_entry__ as E


def test_library_queries_without_the_optional_subpackage(monkeypatch):
    from framelens.plans.queries import QUERIES

    for name in [m for m in sys.modules if m.startswith("framelens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)  # as if the package were not installed
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(E.queries()) == set(QUERIES)
    assert set(E.oracle_sql()) <= set(QUERIES)
