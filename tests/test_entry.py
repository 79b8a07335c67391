"""The driver's contract: every query has oracle columns that match."""

import importlib
import sys

import __spark_entry__ as entry


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 30


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["id", "bm25"]


def test_without_the_llm_folder(monkeypatch):
    hidden = {k: v for k, v in sys.modules.items() if k == "corpus_pipeline" or k.startswith("recollect.llm")}
    for k in hidden:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "recollect.llm", None)
    monkeypatch.delattr(sys.modules["recollect"], "llm", raising=False)
    try:
        m = importlib.reload(entry)
        assert m.llm_queries is None and m.queries() and not any(k.startswith("op") for k in m.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
