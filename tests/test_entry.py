"""The driver's entry: queries, their SQL, and what may be missing."""

import pytest

import __spark_entry__ as entry
from strandloom import queries


def test_every_sequence_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_missing_parts_are_left_out(tmp_path, monkeypatch):
    (tmp_path / "broken_part.py").write_text("import no_such_module_here\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="no_such_module_here"):
        assert entry._present("broken_part") is None
    assert entry._present("strandloom.queries") is queries
