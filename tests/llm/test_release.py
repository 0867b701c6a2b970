"""Workers hand memory back without changing results or hiding errors."""

import pyarrow as pa
import pytest

from revidence.llm import common


def test_released_keeps_batches_and_errors(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert list(common.released(lambda batches: iter(batches))([batch, batch])) == [batch, batch] and calls == [1]

    def bad(batches):
        yield from batches
        raise ValueError
    with pytest.raises(ValueError):
        list(common.released(bad)([batch]))
    t = pa.table({"a": [1]})
    assert common.released_group(lambda x: x)(t) is t and common.released_group(lambda x, y: y)(None, t) is t and len(calls) == 4
    common.release()
