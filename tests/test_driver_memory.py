"""The driver gives back the native memory that it has freed."""

import gc
import re
import time
from pathlib import Path

import pytest

from veracite.sources import shared


def resident(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) // 1024


def test_release_returns_freed_native_memory(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("needs Linux")
    before = resident(pid)
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(2400)]
    last = jvm.java.nio.ByteBuffer.allocateDirect(1 << 16)  # above the freed ones: the library can't shrink past it by itself
    assert resident(pid) - before > 120
    del buffers
    gc.collect()
    for _ in range(3):
        jvm.java.lang.System.gc()
        time.sleep(0.5)
    monkeypatch.setattr(shared, "HEAP_SHARE", 1 << 40)  # any heap is full enough
    held = resident(pid)
    shared.release(spark)
    assert held - resident(pid) > 100
    assert last.capacity() == 1 << 16


def test_a_jvm_without_the_command_is_left_alone(spark, monkeypatch):
    class Gateway:
        def new_array(self, *_):
            raise shared.Py4JError("no such command")

    monkeypatch.setattr(spark.sparkContext, "_gateway", Gateway())
    shared.trim_native_heap(spark)
