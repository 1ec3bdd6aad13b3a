"""Groups of an order in which nulls or one id hold much of a table."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timbrewell.llm import varbyte
from timbrewell.llm.common import RangeGroups
from timbrewell.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string"


def hot_rows():
    rows = [(None, f"no id {k}") for k in range(40)] + [(7, f"hot one {k}") for k in range(40)]
    return rows + [(k, f"plain {k}") for k in range(-5, 30)] + [(10**12, "far"), (7, None), (7, "hot one 3"), (None, None)]


@pytest.mark.parametrize("max_ranges", [4, 256])
def test_hot_values_are_cut_in_order(spark, max_ranges):
    df = spark.createDataFrame(hot_rows(), SCHEMA).withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    groups = RangeGroups(df, "doc_id", 5, max_ranges, hot=True)
    rows = sorted(df.select("doc_id", "crc", groups.key(F.col("crc")).alias("g")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["crc"]))
    order = [r["g"] for r in rows]
    assert order == sorted(order) and order[0] >= 0 and order[-1] < groups.count
    for value in (None, 7):
        held = Counter(r["g"] for r in rows if r["doc_id"] == value)
        assert len(held) > 4 and max(held.values()) < 20
        assert not set(held) & {r["g"] for r in rows if r["doc_id"] != value}


def test_only_nulls_and_no_rows(spark):
    for rows in ([], [(None, "a")], [(None, "a"), (None, "b"), (None, "c")]):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("crc", F.crc32(F.col("text").cast("binary")))
        groups = RangeGroups(df, "doc_id", 1, hot=True)
        assert all(0 <= r["g"] < groups.count for r in df.select(groups.key(F.col("crc")).alias("g")).collect())


@pytest.mark.parametrize("rows_each", [4, 4000])
def test_token_files_of_hot_ids(spark, rows_each):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u2")) for d, t in hot_rows()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].tobytes())))
    want, start = Counter(), 0
    for doc, ids in rows:
        want[doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())] += 1
        start += len(ids)
    df = spark.createDataFrame(hot_rows(), SCHEMA).repartition(3)
    assert Counter(map(tuple, varbyte.round_trip(df, rows_each=rows_each).collect())) == want
