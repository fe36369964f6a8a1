import importlib
import sys

import pytest

import __spark_entry__
from siltbed.plans import shared


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_optional_parts(monkeypatch):
    """The training-data part can be taken away."""
    for name in [m for m in sys.modules if m.startswith("siltbed.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "siltbed.llm", None)
    module = importlib.reload(__spark_entry__)
    assert "pipeline" not in module.queries() and "static_chunk_stats" in module.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_other_missing_modules_are_errors(monkeypatch):
    """Only the optional parts themselves may be missing, not what they import."""

    class Finder:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("no module named tokens", name="tokens")

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Finder(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="tokens"):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.checkpoint_dir(Session)
