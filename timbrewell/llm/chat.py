"""Chat formatting by columnar byte assembly.

A turn is a header, its escaped text and a footer, by role:

    system     <<SYS>>\\n text \\n<</SYS>>\\n\\n
    user       <s>[INST] text [/INST]
    assistant  (space) text </s>
    others     [ROLE:role] text [/ROLE]

Inside texts (and names of other roles) a control string gets a backslash after its first character, one more if
it has some there already, so none is left in a text and unescaping is exact. Segments are laid out in numpy:
lengths, cumulative offsets and scatter indices, then one copy of headers, contents and footers into one
preallocated buffer, of which the Arrow string array is a view. A conversation longer than an Arrow batch comes in
several chunks, so memory is bounded by the batch.

Turns come by turn (nulls first), then role and text. A null text is empty, a null role is the empty role, a null
conv_id a conversation of its own. Repeated rows are turns of their own. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrewell.llm.common import portions, tidy

_CONTROL = r"([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE:|/ROLE\])"
_PARTS = {"system": (b"<<SYS>>\n", b"\n<</SYS>>\n\n"), "user": (b"<s>[INST] ", b" [/INST]"), "assistant": (b" ", b" </s>")}
_OTHER = (b"[ROLE:", b"] ", b" [/ROLE]")
_TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|<s>\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE:(?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.S,
)
#: Rows (conversation, number of chunk, its text, starts and lengths of the loss mask in code points, code points).
CHUNKS = "conv_id long, chunk long, formatted string, loss_start array<int>, loss_length array<int>, chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _CONTROL, r"\1\\\2\3")


_UNESCAPE = re.compile(r"([<\[])\\(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE:|/ROLE\])")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def escape_name(role: str) -> str:
    """Name of another role: no bracket may end it early."""
    return role.replace("%", "%25").replace("]", "%5D").replace("[", "%5B").replace("<", "%3C")


def unescape_name(name: str) -> str:
    return name.replace("%3C", "<").replace("%5B", "[").replace("%5D", "]").replace("%25", "%")


def _views(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array, and where each value starts and its length."""
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    body = array.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copies the slices body[starts : starts + sizes] to out[to :] by one index vector."""
    total = int(sizes.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(to, sizes) + within] = body[np.repeat(starts, sizes) + within]


def assemble(roles: list[str], texts: pa.Array, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of the chunks that start at the turns in breaks; start of each turn's content and its length in bytes."""
    kinds: dict[str, int] = {}
    of = np.array([kinds.setdefault(r, len(kinds)) for r in roles])
    heads, feet = [], []
    for role in kinds:
        if role in _PARTS:
            a, b = _PARTS[role]
        else:
            a, b = _OTHER[0] + escape_name(role).encode() + _OTHER[1], _OTHER[2]
        heads.append(a)
        feet.append(b)
    head_size, foot_size = (np.array([len(x) for x in xs])[of] for xs in (heads, feet))
    head_at, foot_at = ((np.cumsum([len(x) for x in xs]) - [len(x) for x in xs])[of] for xs in (heads, feet))
    body, at, size = _views(escape(texts))
    ends = np.cumsum(head_size + size + foot_size)
    starts = ends - (head_size + size + foot_size)
    out = np.empty(int(ends[-1]), np.uint8)
    _scatter(out, starts, np.frombuffer(b"".join(heads), np.uint8), head_at, head_size)
    _scatter(out, starts + head_size, body, at, size)
    _scatter(out, starts + head_size + size, np.frombuffer(b"".join(feet), np.uint8), foot_at, foot_size)
    offsets = np.append(starts[breaks], ends[-1]).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_string(), len(breaks), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])
    return chunks, starts + head_size, size


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each chunk of each conversation, chunks of one in order and in one partition."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = object(), 0
        for batch in portions(batches, 1000, "text"):
            ids = batch["conv_id"].to_pylist()
            breaks = np.array([k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]])
            roles, texts = batch["role"].to_pylist(), batch["text"]
            chunks, at, size = assemble(roles, texts, breaks)
            body, starts, lengths = _views(chunks)
            points = np.append(0, np.cumsum((body & 0xC0) != 0x80))  # code points before each byte
            loss = np.array([r == "assistant" for r in roles])
            mask_start, mask_length, numbers = [], [], []
            for k, first in enumerate(breaks):
                last = breaks[k + 1] if k + 1 < len(breaks) else len(ids)
                turns = np.flatnonzero(loss[first:last]) + first
                zero = points[starts[k]]
                mask_start.append((points[at[turns]] - zero).tolist())
                mask_length.append((points[at[turns] + size[turns]] - points[at[turns]]).tolist())
                number = number + 1 if ids[first] == held else 0
                held = ids[first]
                numbers.append(number)
            chars = points[starts + lengths] - points[starts]
            columns = [pa.array([ids[k] for k in breaks], pa.int64()), pa.array(numbers, pa.int64()), chunks.cast(pa.string())]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in (mask_start, mask_length)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chars)], ["conv_id", "chunk", "formatted", "loss_start", "loss_length", "chars"])

    return rows.mapInArrow(tidy(run), CHUNKS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a chunk."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted chat")
        kind = found.lastgroup
        role = unescape_name(found["role"]) if kind == "other" else kind
        turns.append((role, unescape(found[kind])))
        at = found.end()
    return turns


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two turns are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def digest(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted chunks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            out = [[d[0], d[1], d[2].hexdigest(), d[3], d[4].hexdigest(), d[5]] for d in done]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in portions(batches, 100):
            done = []
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if state:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for at, n in zip(row["loss_start"], row["loss_length"], strict=True):
                    text = unescape(row["formatted"][at : at + n])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
            if done:
                yield rows(done)
        if state:
            yield rows([state])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_chats(conversations).mapInArrow(tidy(run), schema)


def _quoted(text: str | bytes) -> str:
    text = text.decode() if isinstance(text, bytes) else text
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SIZES = " ".join(f"WHEN '{role}' THEN length({_quoted(a)}) + length({_quoted(b)})" for role, (a, b) in _PARTS.items())
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS k)),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3', 'g')) + CASE role {_SIZES}
  ELSE {len(b"".join(_OTHER))} + length(replace(replace(replace(replace(role, '%', '%25'), ']', '%5D'), '[', '%5B'), '<', '%3C')) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
