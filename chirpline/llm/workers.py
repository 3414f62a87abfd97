"""What a Python worker does around a task's batches (imported on the executors; needs no Spark)."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give the memory that finished work has freed back to the machine.

    Workers live on from stage to stage beside a JVM of fixed size, and both allocators keep freed
    pages otherwise.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_slot: dict = {}


def kept(key, make):
    """What ``make`` gives, kept between the tasks of a worker until something of another key is asked for.

    One slot: a worker that goes from one operator to the next drops the tables of the first.
    """
    if _slot.get("key") != key:
        _slot.clear()
        _slot["value"] = make()
        _slot["key"] = key
    return _slot["value"]


def tidy(run):
    """``run`` over a task's batches, with :func:`release` at its end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task
