"""Packing, token files and chats against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from timbrewell.llm import chat, packing, varbyte
from timbrewell.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, rank int, ids string"
ODD = [
    (1, "a  b   c\n\n d", 0, "x"), (2, None, 1, None), (3, "", 2, "y"), (None, "no id here", 3, "z"), (5, "same text", 0, ""), (5, "same text", 0, ""),
    (5, "other text under one id", 0, ""), (6, "word " * 5000, 0, ""), (7, "é́ Å 中文 <|endoftext|> it's  's", 0, ""), (8, "\n \t ", 0, ""),
]


def encode(name, text):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("table", [odd, real])
def test_packing(spark, sf_dir, table):
    docs = table(spark) if table is odd else table(spark, sf_dir)
    want = Counter()
    for row in docs.collect():
        ids = [*encode("byte_bpe_50k.json", row["text"]), 0]
        at, piece = 0, 0
        size = len(ids) % 2048 or 2048
        while at < len(ids):
            part = ids[at : at + size]
            want[row["doc_id"], piece, at, len(part), crc(part)] += 1
            at, piece, size = at + size, piece + 1, 2048
    got = packing.pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_plan_places_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(20):
        histogram = Counter(int(x) for x in rng.integers(1, 65, rng.integers(1, 400)))
        chosen = packing.plan(histogram, 64)
        held = Counter()
        for config, n in chosen:
            assert sum(size * t for size, t in config.items()) <= 64
            for size, t in config.items():
                held[size] += t * n
        assert held == histogram


def test_knapsack_is_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 20, 5))
        prices = rng.random(len(lengths))
        found = packing.best_configuration(prices, lengths, 30)
        best = np.zeros(31)
        for room in range(31):
            best[room] = max([best[room - 1] if room else 0, *(prices[i] + best[room - x] for i, x in enumerate(lengths) if x <= room)])
        assert sum(lengths[i] * t for i, t in found.items()) <= 30
        assert np.isclose(sum(prices[i] * t for i, t in found.items()), best[30])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack(docs).count() == 0
    assert varbyte.round_trip(docs).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chats).count() == 0


def test_values_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = varbyte.encode_values(values)
        assert (varbyte.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()
    block = varbyte.write_block([4, None], [1, 2], np.array([7, 300, 70000]))
    ids, lengths, values = varbyte.read_block(block)
    assert (ids, lengths.tolist(), values.tolist()) == ([4, None], [1, 2], [7, 300, 70000])


@pytest.mark.parametrize("table", [odd, real])
def test_token_files(spark, sf_dir, table):
    docs = table(spark) if table is odd else table(spark, sf_dir)
    rows = [(r["doc_id"], [*encode("word_bpe_49k.json", r["text"]), 2]) for r in docs.collect()]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], "<u2").tobytes())))
    want, start = Counter(), 0
    for doc, ids in rows:
        want[doc, start, len(ids), crc(ids)] += 1
        start += len(ids)
    assert Counter(map(tuple, varbyte.round_trip(docs).collect())) == want


def plain_digest(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for conv, turns in by.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


def test_chats(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "<<SYS>>\n", "", None, "\\", "[", "<", " </s>", "[ROLE:x] y [/ROLE]", "é中 <s> \n<</SYS>>\n\n", "<<</SYS>>>", "[[INST]]"]
    roles = ["user", "assistant", "system", None, "tool", "a]b", "other", "%5D", "<s>", "role\nx"]
    rows += [(-1, k, roles[k % len(roles)], t) for k, t in enumerate(hard * 5)]
    rows += [(-2, None, "assistant", "x"), (-2, 1, "assistant", "y"), (-2, 1, "assistant", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest(df).collect()
    assert Counter((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got) == plain_digest(rows)
    probe = [r for r in chat.digest(chat.with_probe(df)).collect() if r["conv_id"] == -7]
    assert probe[0]["n_turns"] == 2 and probe[0]["loss_chars"] == len("</s>[INST] ok [/INST]")


def test_long_chats_come_in_chunks(spark):
    rows = [(k % 2, k, "assistant" if k % 3 else "user", f"turn {k} [INST] é") for k in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() > 2
    got = chat.digest(df).collect()
    assert Counter((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got) == plain_digest(rows)
    for r in chat.format_chats(df).collect():
        assert len(r["formatted"]) == r["chars"]
        assert "".join(f"{len(t)}" for _, t in chat.parse(r["formatted"]))
