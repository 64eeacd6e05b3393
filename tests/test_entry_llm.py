import sys

import pytest

import __spark_entry__ as entry
import corvane


def _package(tmp_path, monkeypatch, text):
    (tmp_path / "llm").mkdir()
    (tmp_path / "llm" / "__init__.py").write_text(text)
    monkeypatch.setattr(corvane, "__path__", [str(tmp_path), *corvane.__path__])
    monkeypatch.delitem(sys.modules, "corvane.llm", raising=False)


@pytest.fixture(autouse=True)
def forget():
    yield
    sys.modules.pop("corvane.llm", None)
    vars(corvane).pop("llm", None)


@pytest.mark.parametrize("text", ["import no_such_module_at_all\n", "from corvane.plans import no_such_name\n", "import corvane.llm.absent\n"])
def test_broken_llm_package_is_not_hidden(tmp_path, monkeypatch, text):
    _package(tmp_path, monkeypatch, text)
    with pytest.raises(ImportError):
        entry.queries()


def test_without_llm_package_the_rest_is_there():
    assert "p7_found" in entry.queries()
