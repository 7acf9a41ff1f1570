"""Units of work: runs of equal keys in sorted partitions, streamed to a function."""

from __future__ import annotations

import numpy as np
import pandas as pd


def edges(keys: list[np.ndarray]) -> np.ndarray:
    """Where the tuple of ``keys`` changes, with both ends."""
    n = len(keys[0])
    change = np.zeros(n, dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    change[:1] = True
    return np.append(np.flatnonzero(change), n)


def whole_units(batches, names: list[str]):
    """Frames that hold only whole units of a partition sorted by ``names``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = edges([batch[c].to_numpy() for c in names])[-2]
        starts_new = held and tuple(held[-1][names].iloc[-1]) != tuple(batch[names].iloc[0])
        if cut or starts_new:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)
