"""Whole groups of sorted rows inside Arrow functions, pairs inside of them, and links that span them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that never cut a group; rows come sorted by keys, which hold no nulls."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for c in keys:
            values = table.column(c).to_numpy()
            same &= values == values[-1]
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table


def bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Where groups of equal rows begin, and the number of rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def pairs(at: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows inside the groups that begin at these places, in slices of about `most` pairs."""
    size = np.diff(at)
    after = np.repeat(at[1:], size) - np.arange(int(at[-1])) - 1
    done = np.append(0, np.cumsum(after))
    row = 0
    while row < len(after):
        to = max(row + 1, int(np.searchsorted(done, done[row] + most, "right")) - 1)
        i = np.repeat(np.arange(row, to), after[row:to])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(done[row:to] - done[row], after[row:to])
        row = to


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as u-v do, at most one for each node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
