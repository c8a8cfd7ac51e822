import importlib

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(monkeypatch):
    import importlib.util

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "termweave.llm" else found(name, *a))
    assert "pipeline" not in entry.queries() and not set(entry.oracle_sql()) - set(entry.queries())
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    importlib.reload(entry)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
