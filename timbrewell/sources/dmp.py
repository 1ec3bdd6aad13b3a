"""DMP instrument files: 51 bytes each, decoded and encoded by column expressions."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's length, version, systems, and its operator bytes in order (the last is ignored).
SIZE, VERSION, SYSTEMS = 51, 11, (1, 2)
BYTES = ("mul", "tl", "ar", "dr", "sl", "rr", "am", "rs", "dt", "sr")


def _byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")


def fault(content: Column) -> Column:
    """Why the bytes are no instrument; null if they are."""
    return (
        F.when(F.length(content) < SIZE, F.lit("too small"))
        .when(~_byte(content, 1).isin(*SYSTEMS), F.lit("unknown system"))
        .when(_byte(content, 2) != 1, F.lit("not an FM instrument"))
    )


def patch_name(path: Column) -> Column:
    return F.upper(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^/.]+$", ""))


def decoded(content: Column, path: Column) -> Column:
    """Struct of a patch; null where there is a fault."""
    operators = []
    for k in range(4):
        at = 7 + 11 * k
        fields = [(_byte(content, at + i) != 0 if n == "am" else _byte(content, at + i)).alias(n) for i, n in enumerate(BYTES)]
        operators.append(F.struct(*fields))
    patch = F.struct(
        patch_name(path).alias("name"),
        F.lit("").alias("description"),
        _byte(content, 5).alias("algorithm"),
        _byte(content, 4).alias("feedback"),
        F.lit(0).alias("lfo"),
        _byte(content, 6).alias("ams"),
        _byte(content, 3).alias("fms"),
        F.array(*operators).alias("operators"),
    )
    return F.when(fault(content).isNull(), patch)


def encoded(patch: str = "patch") -> Column:
    """The 51 bytes of a patch struct."""
    p = F.col(patch)
    values = [F.lit(VERSION), F.lit(2), F.lit(1), p["fms"], p["feedback"], p["algorithm"], p["ams"]]
    for k in range(4):
        values += [p["operators"][k][n].cast("int") for n in BYTES] + [F.lit(0)]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.coalesce(v, F.lit(0)).cast("int").bitwiseAND(255)), 2, "0") for v in values]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, patch, fault and whether the version is another than expected, of all .dmp files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dmp").load(path)
    return decode(files)


def decode(files: DataFrame) -> DataFrame:
    """The same for rows of path and content."""
    content = F.col("content")
    other = F.when(F.length(content) >= SIZE, _byte(content, 0) != VERSION)
    return files.select("path", decoded(content, F.col("path")).alias("patch"), fault(content).alias("fault"), other.alias("other_version"))


def bank_entries(slots: DataFrame, folder: str = "BANK") -> DataFrame:
    """File name and bytes of the filled slots (slot, patch)."""
    name = F.format_string(f"{folder}/PATCH%02d.dmp", F.col("slot") + 1)
    return slots.where("patch IS NOT NULL").select("slot", name.alias("path"), encoded().alias("content"))


def bank_archive(slots: DataFrame, folder: str = "BANK") -> bytes:
    """Zip archive of a bank; a bank has at most six slots."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in bank_entries(slots, folder).orderBy("slot").limit(6).collect():
            archive.writestr(row["path"], bytes(row["content"]))
    return out.getvalue()
