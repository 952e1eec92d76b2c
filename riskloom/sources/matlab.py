"""Numeric matrices of MATLAB level 5 files (little- or big-endian, zipped or not)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

# Fixed values of the file format.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, ZIPPED = 14, 15
SPARSE, FIRST_DENSE, LAST_DENSE = 5, 6, 15
HEADER = 128

#: Edges in one batch.
BATCH = 65_536


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, bytes) of the elements that follow each other."""
    at = 0
    while at + 8 <= len(data):
        kind, size = (int(x) for x in np.frombuffer(data[at : at + 8], order + "u4"))
        if kind >> 16:  # a small element: both numbers in the first four bytes
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == ZIPPED else -size % 8)


def _numbers(element: tuple[int, memoryview], order: str) -> np.ndarray:
    kind, data = element
    if kind not in NUMBERS:
        raise ValueError(f"no numbers in an element of type {kind}")
    return np.frombuffer(data, order + NUMBERS[kind])


def cells(content: bytes, variable: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the cells of ``variable`` that are not zero, by column; real parts."""
    order = "<" if content[126:128] == b"IM" else ">"
    for kind, data in _elements(memoryview(content)[HEADER:], order):
        if kind == ZIPPED:
            kind, data = next(_elements(memoryview(zlib.decompress(data)), order))
        if kind != MATRIX:
            continue
        flags, shape, name, *parts = _elements(data, order)
        if bytes(name[1]).decode("ascii") != variable:
            continue
        sort = int(_numbers(flags, order)[0]) & 0xFF
        if sort == SPARSE:
            starts = _numbers(parts[1], order).astype("i8")
            rows, values = (_numbers(part, order)[: starts[-1]] for part in (parts[0], parts[2]))
            columns = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        elif FIRST_DENSE <= sort <= LAST_DENSE:
            values = _numbers(parts[0], order)
            columns, rows = np.divmod(np.arange(len(values)), int(_numbers(shape, order)[0]) or 1)
        else:
            raise ValueError(f"{variable} is no numeric matrix")
        kept = values != 0
        return rows[kept].astype("i8"), columns[kept].astype("i8"), values[kept].astype("f8")
    raise ValueError(f"no variable {variable}")


def edge_batches(variable: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def batches(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in files:
            for content in some["content"]:
                src, dst, weight = cells(bytes(content), variable)
                for first in range(0, len(src), BATCH):
                    part = slice(first, first + BATCH)
                    yield pd.DataFrame({"src": src[part], "dst": dst[part], "weight": weight[part]})

    return batches
