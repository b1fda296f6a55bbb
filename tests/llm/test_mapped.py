"""Shared arrays: an empty shard is told from a folder that a worker does not see."""

import numpy as np
import pytest

from factloom.llm import mapped
from factloom.llm.storage import open_store


def test_missing_files(tmp_path):
    folder = f"file://{tmp_path}"
    mapped.write_arrays(f"{folder}/0", [np.arange(3, dtype=mapped.U64)])
    assert mapped.arrays(f"{folder}/0")[0].tolist() == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        mapped.arrays(f"{folder}/1")
    mapped.mark_complete(folder)
    assert mapped.arrays(f"{folder}/1") is None
    with pytest.raises(FileNotFoundError):
        mapped.SharedSet(f"{folder}/elsewhere", 2).has(np.array([4]))


def test_most_bytes(monkeypatch):
    """Files of a store that cannot be mapped leave memory once they take too much; the newest stays."""
    monkeypatch.setattr(mapped, "_OPEN", type(mapped._OPEN)())
    monkeypatch.setattr(mapped, "_MOST_BYTES", 100)
    monkeypatch.setattr(mapped, "_read", lambda path: [np.zeros(8, dtype=mapped.U64)])
    for i in range(4):
        assert len(mapped.arrays(f"mock://folder/{i}")[0]) == 8
        assert list(mapped._OPEN) == [f"mock://folder/{i}"]


def test_sets(spark):
    numbers = spark.range(0, 5000, 7)
    held = mapped.shared_set(numbers, "numbers")
    assert held.has(np.arange(-3, 5000)).tolist() == [0 <= x < 5000 and x % 7 == 0 for x in range(-3, 5000)]
    nothing = mapped.shared_set(numbers.limit(0), "nothing")
    assert not nothing.has(np.arange(10)).any()


def test_names_of_stores():
    store, inner = open_store("file:///tmp/x")
    assert store.type_name == "local" and inner == "/tmp/x"
