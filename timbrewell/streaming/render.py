"""Sound of a patch: a four-operator phase-modulation voice, rendered by job.

Built from the chip's public description (eight algorithms, self-feedback of the first operator, levels in steps of
0.75 dB, attack and decay by rate), with plain sines and exponential envelopes in floating point. It is a voice of the
same structure and controls, not a sample-exact emulation. A render is a recurrence, so each job is one group; jobs run
beside one another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 44_100
#: For each algorithm: which operators modulate operators 2 to 4, and which are heard.
ROUTES: tuple[tuple[tuple[tuple[int, ...], ...], tuple[int, ...]], ...] = (
    (((0,), (1,), (2,)), (3,)),
    (((), (0, 1), (2,)), (3,)),
    (((), (1,), (0, 2)), (3,)),
    (((0,), (), (1, 2)), (3,)),
    (((0,), (), (2,)), (1, 3)),
    (((0,), (0,), (0,)), (1, 2, 3)),
    (((0,), (), ()), (1, 2, 3)),
    (((), (), ()), (0, 1, 2, 3)),
)


def envelope(ar: int, dr: int, sr: int, sl: int, rr: int, n: int, off: int) -> np.ndarray:
    """Level from 0 to 1 of each sample: attack, decay to the sustain level, slow decay, release from sample off."""

    def share(rate: int, full: int) -> float:
        return 0.0 if rate <= 0 else min(1.0, 2.0 ** (rate * 16.0 / full - 18.0) * 64)

    floor = 0.0 if sl >= 15 else 10 ** (-3.0 * sl / 20)
    out, level, falling = np.empty(n), 0.0, False
    up, down, slow, release = share(ar, 31), share(dr, 31) / 8, share(sr, 31) / 16, share(rr, 15) / 8
    for k in range(n):
        if k >= off:
            level *= 1 - release
        elif not falling:
            level += (1.0 - level) * up
            falling = level > 0.999
        else:
            level *= 1 - (down if level > floor else slow)
        out[k] = level
    return out


def render(patch: dict, note: int, n: int, off: int) -> np.ndarray:
    """n samples, from -1 to 1."""
    hertz = 440 * 2 ** ((note - 69) / 12)
    at = np.arange(n) / RATE
    sounds: list[np.ndarray] = []
    modulators, heard = ROUTES[int(patch["algorithm"]) & 7]
    feedback = 0.0 if not patch["feedback"] else np.pi * 2.0 ** (int(patch["feedback"]) - 8) * 8
    for k, op in enumerate(patch["operators"]):
        level = envelope(op["ar"], op["dr"], op["sr"], op["sl"], op["rr"], n, off) * 10 ** (-0.75 * op["tl"] / 20)
        phase = 2 * np.pi * hertz * (op["mul"] or 0.5) * at
        if k == 0 and feedback:
            out, a, b = np.empty(n), 0.0, 0.0
            for j in range(n):
                a, b = level[j] * np.sin(phase[j] + feedback * (a + b) / 2), a
                out[j] = a
        else:
            bend = sum((sounds[m] for m in modulators[k - 1]), np.zeros(n)) * 4 * np.pi if k else 0.0
            out = level * np.sin(phase + bend)
        sounds.append(out)
    return np.clip(sum(sounds[k] for k in heard) / len(heard), -1, 1)


def rendered(jobs: DataFrame, samples: int = 4096) -> DataFrame:
    """job, sample, left and right for jobs of job, note, off (sample of release) and patch."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        sound = render(row["patch"], int(row["note"]), samples, int(row["off"]))
        return pd.DataFrame({"job": key[0], "sample": np.arange(samples), "left": sound, "right": sound})

    return jobs.groupBy("job").applyInPandas(run, "job long, sample int, left double, right double")


def in_blocks(sound: DataFrame, frames: int = 4096, gain: float = 1.0) -> DataFrame:
    """job, block, left and right: the samples of each job in the buffers of an audio callback, the last one padded."""
    block = F.floor(F.col("sample") / frames).cast("int")
    held = sound.groupBy("job", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("sample", F.lit(frames)).alias("k"), "left", "right"))).alias("s"))
    side = lambda c: F.slice(F.concat(F.transform("s", lambda x: x[c] * gain), F.array_repeat(F.lit(0.0), frames)), 1, frames)
    return held.select("job", "block", side("left").alias("left"), side("right").alias("right"))
