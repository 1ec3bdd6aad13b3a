"""Streams of played notes: voices, held keys and slots.

The same rules run in batch (windows) and as structured streams (arbitrary state by session).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from timbrewell.functions.synth import CHANNELS

#: Number-pad keys and their intervals from C.
KEYS = {"Numpad0": 0, "NumpadDecimal": 1, "Numpad1": 2, "Numpad2": 3, "Numpad3": 4, "Numpad4": 5, "Numpad5": 6, "Numpad6": 7, "Numpad7": 8, "Numpad8": 9, "Numpad9": 10, "NumpadDivide": 11, "NumpadMultiply": 12}

#: Rows of a session that a worker holds as Python values before they leave.
ROWS_AT_ONCE = 50_000


def round_robin(note_ons: DataFrame, session: str, order: str) -> DataFrame:
    """note_ons with the channel each takes: one after another, six in a circle, by session."""
    return note_ons.withColumn("channel", (F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1) % CHANNELS)


def releases(note_ons: DataFrame, note_offs: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """session, off_seq and channel: the channels that a note-off frees.

    A channel plays a note from its note-on to the next note-on it takes or the first note-off of that note.
    """
    dealt = round_robin(note_ons, session, order)
    later = F.lead(order).over(Window.partitionBy(session, "channel").orderBy(order))
    spans = dealt.withColumn("until", later).select(session, "note", F.col(order).alias("_at"), "channel", "until", F.lit(None).cast(note_offs.schema[order].dataType).alias("_off"))
    offs = note_offs.select(session, "note", F.col(order).alias("_at"), F.lit(None).cast(spans.schema["channel"].dataType).alias("channel"), F.lit(None).cast(spans.schema["until"].dataType).alias("until"), F.col(order).alias("_off"))
    # backwards, so that the last off that was met is the next one; an off at a span's own place is none of its
    back = Window.partitionBy(session, "note").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    met = spans.unionAll(offs).withColumn("off_seq", F.last("_off", True).over(back)).where("_off IS NULL AND off_seq IS NOT NULL")
    return met.where("until IS NULL OR off_seq < until").select(session, "off_seq", "channel")


def last_slots(changes: DataFrame, order: str = "seq") -> DataFrame:
    """slot and patch after all changes: the last write to a slot counts, null clears it."""
    last = changes.groupBy("slot").agg(F.max_by(F.struct("patch"), order).alias("r"))
    return last.select("slot", "r.patch").where("patch IS NOT NULL")


def presses(key_events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """Key-downs that sound: those of a key that is not held already (repeats are dropped)."""
    before = F.lag("down").over(Window.partitionBy(session, "key").orderBy(order))
    return key_events.withColumn("_before", before).where(F.col("down") & ~F.coalesce(F.col("_before"), F.lit(False))).drop("_before")


def _allot(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    following, notes = state.get if state.exists else (0, [-1] * CHANNELS)
    notes, rows = list(notes), []
    # a trigger's events of one session come in any order
    events = pd.concat(list(frames)).sort_values("seq")
    for seq, note, on in zip(events["seq"], events["note"], events["is_on"], strict=True):
        if len(rows) >= ROWS_AT_ONCE:
            yield _allotted(rows)
            rows = []
        if on:
            notes[following] = int(note)
            rows.append((key[0], int(seq), int(note), True, following))
            following = (following + 1) % CHANNELS
        else:
            for channel in range(CHANNELS):
                if notes[channel] == note:
                    notes[channel] = -1
                    rows.append((key[0], int(seq), int(note), False, channel))
    state.update((following, notes))
    yield _allotted(rows)


def _allotted(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "seq", "note", "is_on", "channel"])


def stream_voices(events: DataFrame) -> DataFrame:
    """Stream of session, seq, note, is_on and channel from a stream of session, seq, note and is_on."""
    return events.groupBy("session").applyInPandasWithState(
        _allot, "session long, seq long, note int, is_on boolean, channel int", "following int, notes array<int>", "append", "NoTimeout"
    )


def stream_slots(changes: DataFrame) -> DataFrame:
    """Stream (in complete mode) of the last write of each slot."""
    return changes.groupBy("slot").agg(F.max_by("patch", "seq").alias("patch"))
