"""Columns, valid ranges and types of presets: one table drives schemas, checks, clamps and fixtures."""

from __future__ import annotations

from pyspark.sql import types as T

# The OPM file format's fields in file order, with the upper bounds of their valid ranges (all from 0).
LFO = {"LFRQ": 255, "AMD": 255, "PMD": 255, "WF": 3, "NFRQ": 31}
CHANNEL = {"PAN": 3, "FL": 7, "CON": 7, "AMS": 3, "PMS": 7, "SLOT": 15, "NE": 1}
OPERATOR = {"AR": 31, "D1R": 31, "D2R": 31, "RR": 15, "D1L": 15, "TL": 127, "KS": 3, "MUL": 15, "DT1": 7, "DT2": 3, "AMS_EN": 1}
SLOTS = ("M1", "C1", "M2", "C2")

#: Highest valid value of each of the 56 parameters, in feature order.
HIGHEST: dict[str, int] = LFO | CHANNEL | {f"{s}_{p}": hi for s in SLOTS for p, hi in OPERATOR.items()}
FEATURES: list[str] = list(HIGHEST)
LEVELS: list[str] = [f"{s}_TL" for s in SLOTS]

PRESET = T.StructType(
    [T.StructField("preset_id", T.LongType()), T.StructField("Num", T.IntegerType()), T.StructField("Name", T.StringType())]
    + [T.StructField(f, T.IntegerType()) for f in FEATURES]
    + [T.StructField("Filename", T.StringType())]
)

# Names, colours of the seven clusters and flags and colours of nationalities, as users see them.
CLUSTERS = {0: "Raw Signals", 1: "Neon Action", 2: "Polished Arcade", 3: "High-Speed Chiptune", 4: "Deep Space FM", 5: "Fantasy Atmospheres", 6: "Experimental Playgrounds"}
CLUSTER_COLOURS = {0: "#bc13fe", 1: "#00eaff", 2: "#00ff88", 3: "#ff0080", 4: "#00d4ff", 5: "#ff5722", 6: "#8b5cf6"}
NO_COLOUR = "#666"

OPERATOR_PARAMS = T.StructType([T.StructField(p.lower(), T.IntegerType()) for p in OPERATOR])
DATASET_PRESET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("game", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("composer", T.StringType()),
        T.StructField("nationality", T.StringType()),
        T.StructField("gems", T.BooleanType()),
        T.StructField("brightness", T.DoubleType()),
        T.StructField("complexity", T.DoubleType()),
        T.StructField("con", T.IntegerType()),
        T.StructField("fl", T.IntegerType()),
        T.StructField("params", T.StructType([T.StructField(p, T.IntegerType()) for p in ("lfrq", "amd", "pmd", "wf", "nfrq", "pan", "ams", "pms", "slot", "ne")] + [T.StructField(s.lower(), OPERATOR_PARAMS) for s in SLOTS])),
    ]
)
DATASET = T.StructType([T.StructField("presets", T.ArrayType(DATASET_PRESET)), T.StructField("nationalities", T.ArrayType(T.StringType()))])
