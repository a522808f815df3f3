import importlib
import importlib.util
import sys

import pytest


@pytest.fixture
def entry():
    import __spark_entry__

    yield __spark_entry__
    importlib.reload(__spark_entry__)


def test_without_training_data(entry, monkeypatch):
    """Where the pipeline or its folder is missing, the other queries are there, and each has its SQL."""
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None if name == "corpus_pipeline" else find(name))
    importlib.reload(entry)
    assert set(entry.queries()) == set(entry.oracle_sql()) and "entity_counts" in entry.queries()
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


def test_failing_imports_show(entry, monkeypatch):
    if not importlib.util.find_spec("corpus_pipeline"):
        pytest.skip("no pipeline")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import raises
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: True)
    with pytest.raises(ImportError):
        importlib.reload(entry)
