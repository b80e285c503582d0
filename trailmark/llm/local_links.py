"""Components of the links found inside one task, and runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (index of a member, the same for all of a component) after linking a[i] and b[i]."""
    while True:
        left, right = labels[a], labels[b]
        differ = left != right
        if not differ.any():
            return labels
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels = shorter


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table. The batches must be sorted by ``keys``, whole numbers."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            key = tuple(values[start] for values in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
