"""OPM bank files: text to preset rows, from tables of texts, folders or zip archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timbrewell.schema import CHANNEL, LFO, OPERATOR, PRESET, SLOTS

#: preset_id = file number * this + place in the file.
IDS_A_FILE = 1 << 20
_NBSP = "\u00a0"
KINDS = {"LFO": list(LFO), "CH": list(CHANNEL)} | {s: [f"{s}_{p}" for p in OPERATOR] for s in SLOTS}


def parse(files: DataFrame) -> DataFrame:
    """Preset rows of files (file_no, path, content).

    A name line opens a preset; 'no name' presets give nothing. The first LFO and the first CH line of a file are its
    header and are passed over, so lines are counted by kind and meet by their number; what is short gets nulls.
    Tokens that are no integers become null, and tokens beyond the columns are dropped. A file of more presets than it
    has ids ends the job. A file is cut, filtered and zipped within its row: nothing is shuffled.
    """
    blank, edges = f"(?:[^\\S\\n]|{_NBSP})", rf"^[\s{_NBSP}]+|[\s{_NBSP}]+$"
    name = rf"@:(\d+)[^\S\n]([^\n]+)"
    # cut before each line that holds a name; what follows a 'no name' goes with it
    presets = F.filter(F.split("content", rf"(?dm)^(?=[^\n]*@:\d+[^\S\n][^\n])"), lambda x: F.lower(F.regexp_replace(F.regexp_extract(x, name, 2), edges, "")) != "no name")
    kept = files.select("file_no", "path", F.array_join(presets, "").alias("_kept"))
    bodies = {kind: F.regexp_extract_all("_kept", F.lit(rf"{kind}:{blank}([^\n]+)"), F.lit(1)) for kind in KINDS}
    bodies |= {kind: F.slice(bodies[kind], 2, 1 << 30) for kind in ("LFO", "CH")}
    parts = [F.regexp_extract_all("_kept", F.lit(name), F.lit(k)).alias(c) for k, c in ((1, "_num"), (2, "_title"))]
    rows = kept.select("file_no", "path", F.posexplode(F.arrays_zip(*parts, *[b.alias(f"_{k}") for k, b in bodies.items()])).alias("ordinal", "p"))
    rows = rows.select("file_no", F.col("path").alias("Filename"), "ordinal", "p.*")
    columns = {"Num": F.col("_num").cast("int"), "Name": F.regexp_replace("_title", edges, "")}
    for kind, names in KINDS.items():
        tokens = F.filter(F.split(f"_{kind}", rf"[\s{_NBSP}]+"), lambda t: t != "")
        columns |= {n: F.get(tokens, F.lit(i)).try_cast("int") for i, n in enumerate(names)}
    number = F.col("file_no").cast("long") * IDS_A_FILE + F.col("ordinal")
    columns["preset_id"] = F.when(F.col("ordinal") < IDS_A_FILE, number).otherwise(F.raise_error(F.concat(F.lit("too many presets in "), "Filename")).cast("long"))
    return rows.withColumns(columns).select(*[f.name for f in PRESET.fields])


def malformed(files: DataFrame) -> DataFrame:
    """Presets with missing values, for a report; parse keeps them."""
    missing = F.array_compact(F.array(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in PRESET.fields]))
    return parse(files).select("preset_id", "Filename", missing.alias("missing")).where(F.size("missing") > 0)


def strict(files: DataFrame) -> DataFrame:
    """parse, but a preset with missing values ends the job."""
    bad: Column = F.array_max(F.array(*[F.col(f.name).isNull() for f in PRESET.fields]))
    return parse(files).withColumn("Name", F.when(bad, F.raise_error(F.concat(F.lit("malformed preset in "), "Filename"))).otherwise(F.col("Name")))


class _Entries(InputPartition):
    def __init__(self, start: int, names: list[str]):
        self.start, self.names = start, names


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".opm")
        self.group = int(options.get("entriesPerPartition", "200"))

    def partitions(self) -> list[InputPartition]:
        # entries are chosen by name before any is decoded
        with zipfile.ZipFile(self.path) as archive:
            names = [n for n in archive.namelist() if n.endswith(self.suffix)]
        return [_Entries(k, names[k : k + self.group]) for k in range(0, len(names), self.group)] or [_Entries(0, [])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        if partition.names:
            with zipfile.ZipFile(self.path) as archive:
                for k, name in enumerate(partition.names):
                    yield partition.start + k, name, archive.read(name).decode("utf-8")


class ZipTexts(DataSource):
    """Text entries of a zip archive (on a file system that all executors mount), some to a partition."""

    @classmethod
    def name(cls) -> str:
        return "ziptexts"

    def schema(self) -> str:
        return "file_no int, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZipTexts)
    return parse(spark.read.format("ziptexts").load(path))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .opm files below a folder, numbered by their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.opm").load(path)
    numbered = files.select("path", F.decode("content", "UTF-8").alias("content"))
    order = numbered.select("path").withColumn("file_no", F.row_number().over(Window.orderBy("path")) - 1)
    return parse(numbered.join(order, "path"))


def write_text(presets: DataFrame) -> DataFrame:
    """content of an OPM file for each Filename: the inverse of parse for complete presets."""
    body = [F.format_string("@:%d %s", "Num", "Name")]
    body += [F.concat(F.lit(f"{kind}: "), F.concat_ws(" ", *names)) for kind, names in KINDS.items()]
    entry = F.concat_ws("\n", *body)
    head = F.lit("//LFO: LFRQ AMD PMD WF NFRQ\n//CH: PAN FL CON AMS PMS SLOT NE\n")
    entries = F.array_sort(F.collect_list(F.struct("preset_id", entry.alias("e"))))
    return presets.groupBy("Filename").agg(F.concat(head, F.array_join(F.transform(entries, lambda x: x["e"]), "\n")).alias("content"))
