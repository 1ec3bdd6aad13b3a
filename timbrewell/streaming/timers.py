"""The chip's two timers and the key-ons that timer A makes in CSM mode.

Timer A has 10 bits and counts samples, timer B has 8 bits and counts sixteen samples at a time. Between two writes to
the mode register all overflows are known at once, so a chip's history is a walk over its writes, not over its samples;
chips run beside one another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Bits of the mode register.
LOAD_A, LOAD_B, ENABLE_A, ENABLE_B, RESET_A, RESET_B = 1, 2, 4, 8, 16, 32
CSM_BITS, CSM = 0xC0, 0x80
OVERFLOWS = "chip long, sample long, timer string, flagged boolean, key_on boolean"


def overflows(writes: list[tuple[int, int, int, int]], until: int) -> list[tuple[int, str, bool, bool]]:
    """(sample, timer, flagged, key_on) of the overflows before a sample.

    writes: (sample, timer A's value, timer B's value, mode), in order. A timer starts from its value when its load bit
    is set anew, runs while that is set, and takes a changed value at its next overflow. flagged: the timer's status
    bit, which was clear, is set; key_on: the third channel is keyed on.
    """
    left, mode, status, out = [0, 0], 0, [False, False], []
    ends = [w[0] for w in writes[1:]] + [until]
    for (at, a, b, now), end in zip(writes, ends, strict=True):
        period = (1024 - (a & 1023), (256 - (b & 255)) * 16)
        found = []
        for k, (load, enable, reset) in enumerate(((LOAD_A, ENABLE_A, RESET_A), (LOAD_B, ENABLE_B, RESET_B))):
            if now & load and not mode & load:
                left[k] = period[k]
            if now & reset:
                status[k] = False
            if not now & load:
                continue
            hits = np.arange(at + left[k], min(end, until), period[k])
            left[k] = left[k] - (end - at) if not len(hits) else int(hits[-1]) + period[k] - end
            for n, x in enumerate(hits.tolist()):
                fresh = bool(now & enable) and not status[k] and n == 0
                found.append((x, "AB"[k], fresh, k == 0 and now & CSM_BITS == CSM))
            status[k] = status[k] or bool(len(hits) and now & enable)
        out += sorted(found)
        mode = now
    return out


def timer_events(writes: DataFrame, until: int) -> DataFrame:
    """The overflows of each chip, from its writes (chip, sample, a, b, mode) to a sample."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = overflows(list(frame.sort_values("sample", kind="stable")[["sample", "a", "b", "mode"]].itertuples(index=False, name=None)), until)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["chip", "sample", "timer", "flagged", "key_on"])

    return writes.groupBy("chip").applyInPandas(run, OVERFLOWS)
