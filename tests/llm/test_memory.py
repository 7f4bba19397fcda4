"""What a Python worker holds between its tasks."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from cohortsift.llm.shingles import give_back, parts


def held():
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory cannot be read here")
def test_what_a_task_freed_goes_back_before_the_next():
    give_back()
    before = held()
    arrays = [pa.array(["x" * 1000] * 400) for _ in range(400)]  # 160 MB
    assert held() > before + 140
    del arrays
    assert list(parts(iter([]))) == []
    assert held() < before + 60


def test_the_last_batch_goes_back_as_well(monkeypatch):
    seen = []
    monkeypatch.setattr("cohortsift.llm.shingles.give_back", lambda: seen.append(len(seen)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", None, "b"])], ["doc_id", "text"])
    assert [p.num_rows for p in parts(iter([batch, batch]))] == [3, 3] and len(seen) == 2
