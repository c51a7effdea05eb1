"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def whole_groups(
    batches: Iterator[pd.DataFrame], by: Sequence[str]
) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames holding complete groups, with the row range of each.

    Rows come sorted by ``by``. Many short groups share a frame; a group cut by the end of a batch
    waits for the next one.
    """
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True) if rest is None else pd.concat([rest, pdf], ignore_index=True)
        fresh = np.zeros(len(pdf), bool)
        fresh[0] = True
        for k in by:
            values = pdf[k].to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh).tolist()
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]], list(zip(starts[:-1], starts[1:]))
        rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None:
        yield rest, [(0, len(rest))]
