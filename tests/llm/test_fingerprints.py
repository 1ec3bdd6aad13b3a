"""Fingerprints against a plain Merkle tree."""

import hashlib
import random
import re
from collections import Counter

import pytest

from timbrewell.llm import fingerprints
from timbrewell.llm.common import RangeGroups


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(text):
    leaves = re.findall(r"[^\n]{1,64}\n?|\n", text)
    marked = "".join(md5(x) + ("/" if x.endswith("\n") else "") for x in leaves)
    tree = "".join(p + "/" + ("|" if md5(p)[0] in "08" else "") for p in marked.split("/") if p)
    nodes = "".join(md5("".join(md5(p) for p in s.split("/"))) for s in tree.split("|"))
    return hashlib.sha256(nodes.encode()).hexdigest() + ":" + re.sub("([0-9a-f]{16})[0-9a-f]{16}", r"\1", tree)


def like(a, b):
    if a == b:
        return 1.0
    x, y = ({f[65:][m.start() : m.end()] for m in re.finditer("[0-9a-f]{16}", f[65:])} for f in (a, b))
    n = len(x) + len(y)
    return min(2 * len(x & y) / max(n, 1), 1 - 1 / (n + 1))


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = Counter()
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(plain, (text, edited, after))
        out[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)] += 1
    return out


def found(df, rows_each):
    rows = fingerprints.fingerprints(df, rows_each).collect()
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)


def texts():
    rng = random.Random(4)
    pick = lambda n: "".join(rng.choice("ab é\n中") for _ in range(n))
    ids = sorted(rng.sample(range(-50, 10**12), 60)) + [5, 5, 5]
    return [(k, pick(rng.randint(0, 400))) for k in ids] + [(None, "x"), (None, None), (7, None), (8, ""), (9, "\n\n\n"), (10, "z" * 300), (5, "twin"), (5, "twin")]


@pytest.mark.parametrize("rows_each", [3, 1000])
def test_against_plain(spark, rows_each):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, next_text int, fingerprint string").repartition(3)
    assert found(df, rows_each) == expected(rows)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    row = fingerprints.fingerprints(df).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_branches_locate_an_edit():
    text = "\n".join(f"paragraph {k}" for k in range(40))
    a, b = plain(text), plain(text.replace("paragraph 17", "paragraph x"))
    assert a != b
    sections = [set(x[65:].split("|")) for x in (a, b)]
    assert len(sections[0] - sections[1]) <= 2


def test_groups_follow_the_order(spark):
    rng = random.Random(2)
    ids = [rng.choice([rng.randrange(100), 10**15 + rng.randrange(10**6)]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in ids] + [(None,)], "doc_id long")
    groups = RangeGroups(df, "doc_id", 10, max_ranges=8)
    got = {r["doc_id"]: r["g"] for r in df.select("doc_id", groups.key().alias("g")).collect()}
    order = [got[k] for k in sorted(set(ids))]
    assert order == sorted(order) and got[None] == 0 and max(order) < groups.count and len(set(order)) > 8


def test_leaves_that_begin_alike_differ(spark):
    """Two texts whose hashes agree in 32 bits have other fingerprints."""
    seen, pair, k = {}, None, 0
    while not pair:
        text = f"clause {k:09d} is the same in all of these contracts"
        other = seen.setdefault(md5(text)[:8], text)
        pair, k = (other, text) if other != text else None, k + 1
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    assert rows[0]["fingerprint"] != rows[1]["fingerprint"] and rows[0]["near_next"] < 1
