"""Notes, frequency numbers and register writes of the chip, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK, CHANNELS = 7_670_448, 6
# The chip's register offsets of the four operators, in patch order.
OFFSETS = (0, 8, 4, 12)
OPERATOR_FIELDS = ("mul", "tl", "ar", "dr", "sl", "rr", "rs", "dt", "sr")


def midi_note(octave: Column, interval: Column) -> Column:
    """Note of an interval in an octave from 0 to 7."""
    return (F.greatest(F.lit(0), F.least(F.lit(7), octave)) + 1) * 12 + interval


def frequency_number(note: Column) -> Column:
    """Struct of block and fnum: the lowest block from the note's own whose number fits 11 bits."""
    hertz = F.lit(440.0) * F.pow(F.lit(2.0), (note - 69) / 12.0)
    base = hertz * (1048576.0 * 144) / CLOCK
    start = F.greatest(F.lit(0), F.least(F.lit(7), F.floor((note - 12) / 12.0))).cast("int")
    choice = F.transform(F.sequence(start, F.lit(7)), lambda b: F.struct(b.alias("block"), F.floor(base / F.pow(F.lit(2.0), b - 1) + 0.5).cast("int").alias("fnum")))
    fits = F.filter(choice, lambda c: c["fnum"] <= 2047)
    top = F.struct(F.lit(7).alias("block"), F.lit(2047).alias("fnum"))
    return F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(top)


def _bits(c: Column, mask: int, shift: int = 0) -> Column:
    return F.shiftleft(F.coalesce(c, F.lit(0)).cast("int").bitwiseAND(mask), shift)


def _write(address: Column, value: Column) -> Column:
    return F.struct(address.cast("int").alias("address"), value.cast("int").alias("value"))


def channel_base(channel: Column) -> Column:
    """Register base of channels 0 to 5: the second three are in the second bank."""
    return F.when(channel >= 3, 0x100).otherwise(0) + channel % 3


def patch_writes(channel: Column, patch: str = "patch") -> Column:
    """Array of the 30 writes that load a patch struct into a channel."""
    p, base = F.col(patch), channel_base(channel)
    out = [
        _write(base + 0xB0, _bits(p["feedback"], 7, 3).bitwiseOR(_bits(p["algorithm"], 7))),
        _write(base + 0xB4, F.lit(0xC0).bitwiseOR(_bits(p["ams"], 3, 4)).bitwiseOR(_bits(p["fms"], 7))),
    ]
    for k, offset in enumerate(OFFSETS):
        op, at = p["operators"][k], base + offset
        am = F.when(op["am"], 0x80).otherwise(0)
        out += [
            _write(at + 0x30, _bits(op["dt"], 7, 4).bitwiseOR(_bits(op["mul"], 15))),
            _write(at + 0x40, _bits(op["tl"], 127)),
            _write(at + 0x50, _bits(op["rs"], 255, 6).bitwiseOR(_bits(op["ar"], 31))),
            _write(at + 0x60, am.bitwiseOR(_bits(op["dr"], 31))),
            _write(at + 0x70, _bits(op["sr"], 31)),
            _write(at + 0x80, _bits(op["sl"], 15, 4).bitwiseOR(_bits(op["rr"], 15))),
            _write(at + 0x90, F.lit(0)),
        ]
    return F.array(*out)


def key_channel(channel: Column) -> Column:
    return channel + (channel >= 3).cast("int")


def note_on_writes(channel: Column, note: Column) -> Column:
    """Array of the three writes that start a note."""
    number, base = frequency_number(note), channel_base(channel)
    high = F.shiftleft(number["block"], 3).bitwiseOR(F.shiftright(number["fnum"], 8).bitwiseAND(7))
    return F.array(_write(base + 0xA4, high), _write(base + 0xA0, number["fnum"].bitwiseAND(255)), _write(F.lit(0x28), F.lit(0xF0).bitwiseOR(key_channel(channel).cast("int"))))


def note_off_write(channel: Column) -> Column:
    return _write(F.lit(0x28), key_channel(channel))


def gain(sample: Column) -> Column:
    """A chip sample as a share of full scale."""
    return sample / 4096.0


def patch_of_preset() -> Column:
    """Struct of a patch from the columns of a preset row; second detune and most LFO fields have no place in it."""
    operators = [
        F.struct(
            *[F.col(f"{s}_{a}").alias(b) for a, b in (("MUL", "mul"), ("TL", "tl"), ("AR", "ar"), ("D1R", "dr"), ("D1L", "sl"), ("RR", "rr"))],
            (F.col(f"{s}_AMS_EN") == 1).alias("am"),
            *[F.col(f"{s}_{a}").alias(b) for a, b in (("KS", "rs"), ("DT1", "dt"), ("D2R", "sr"))],
        )
        for s in ("M1", "C1", "M2", "C2")
    ]
    return F.struct(
        F.col("Name").alias("name"),
        F.concat(F.col("Game"), F.coalesce(F.concat(F.lit(" - "), F.col("Composer")), F.lit(""))).alias("description"),
        F.col("CON").alias("algorithm"),
        F.col("FL").alias("feedback"),
        F.col("LFRQ").alias("lfo"),
        F.col("AMS").alias("ams"),
        F.col("PMS").alias("fms"),
        F.array(*operators).alias("operators"),
    )


def patch_table(patches: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key and parameter, with a column for each of the four operators."""
    names = ("ar", "dr", "sr", "rr", "sl", "tl", "mul", "dt")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), *[F.col("patch.operators")[k][n].alias(f"op{k + 1}") for k in range(4)]) for n in names]))
    return patches.select(*keys, rows.alias("r")).select(*keys, "r.*")
