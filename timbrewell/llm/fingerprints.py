"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces (native functions only).

Leaves are pieces of at most 64 code points that start anew at each paragraph (a line with its line feed). A
paragraph's node hashes its leaves, a section's node its paragraphs, the root its sections. A section ends after a
paragraph whose node starts with 0 or 8, so an insertion moves no later section. All nodes hash the whole MD5 of what
is below them, so roots test equality. The fingerprint is the root's SHA-256 in hex, a colon, and a mark for each leaf
(the first MARK hex digits of its hash) with / after each paragraph and | after each section: unequal branches say where
two texts differ, and common marks how like they are.

Null text counts as empty: no leaves and the root of nothing. Equal texts have equal fingerprints whatever their
other columns. Rows with one id come in the order of their texts; all null ids are one group, which one task
orders. A single row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrewell.llm.common import RangeGroups

PIECE, MARK = 64, 16
#: Groups whose bounds (some 32 bytes each) are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 200_000


def _sql(text: str) -> str:
    """SQL of the tree of a string expression."""
    leaves = f"regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}\\\\n?|\\\\n', 0)"
    marked = f"array_join(transform({leaves}, x -> concat(md5(x), CASE WHEN endswith(x, '\\n') THEN '/' ELSE '' END)), '')"
    paragraphs = f"filter(split({marked}, '/'), x -> x <> '')"
    nodes = f"transform({paragraphs}, x -> concat(x, '/', CASE WHEN substring(md5(x), 1, 1) IN ('0', '8') THEN '|' ELSE '' END))"
    return f"array_join({nodes}, '')"


def tree(text: Column | str) -> Column:
    """The leaves of the tree with the ends of paragraphs and sections."""
    return F.expr(_sql(text))


def fingerprint(tree_column: str) -> Column:
    """Root and marks of the leaves; the root hashes the nodes of the sections, which hash those of their paragraphs."""
    nodes = F.expr(f"array_join(transform(split({tree_column}, '[|]'), s -> md5(array_join(transform(split(s, '/'), p -> md5(p)), ''))), '')")
    marks = F.regexp_replace(tree_column, f"([0-9a-f]{{{MARK}}})[0-9a-f]{{{32 - MARK}}}", "$1")
    return F.concat(F.sha2(nodes, 256), F.lit(":"), marks)


def leaf_set(fp: str) -> Column:
    """Distinct marks of a fingerprint."""
    return F.expr(f"array_distinct(regexp_extract_all(substring({fp}, 66), '[0-9a-f]{{{MARK}}}', 0))")


def likeness(a: str, b: str, set_a: str, set_b: str) -> Column:
    """1 for equal fingerprints, else twice the common leaves over all leaves, under 1."""
    both = F.size(set_a) + F.size(set_b)
    share = F.size(F.array_intersect(set_a, set_b)) * F.lit(2.0) / F.greatest(both, F.lit(1))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.least(share, F.lit(1.0) - F.lit(1.0) / (both + 1)))


def changed_paragraphs(a: str, b: str) -> Column:
    """Positions (from 0) of the paragraphs of a's tree that b lacks, found by unequal branches."""
    return F.expr(
        f"transform(filter(transform(split(replace(substring({a}, 66), '|', ''), '/'), (p, i) -> struct(p AS p, i AS i)),"
        f" x -> x.p <> '' AND NOT array_contains(split(replace(substring({b}, 66), '|', ''), '/'), x.p)), x -> x.i)"
    )


def with_next(docs: DataFrame, rows_each: int = 1000) -> DataFrame:
    """docs with next_text and next_fp of the following doc_id, after the last those of the first.

    Groups of neighbouring ids are dealt out by hash; the first rows of each group are also sent to the group
    before, so that no window spans more than one group.
    """
    groups = RangeGroups(docs, "doc_id", rows_each)
    keyed = docs.withColumn("_group", groups.key())
    firsts = keyed.groupBy("_group").agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
    firsts = firsts.withColumn("_first", F.when(~F.col("_null"), F.col("_first")))
    coarse = F.floor(F.col("_group") / groups.parts)
    inner, outer = Window.partitionBy("_c").orderBy("_group"), Window.orderBy("_c")
    firsts = firsts.withColumn("_c", coarse)
    ends = firsts.groupBy("_c").agg(F.max("_group").alias("_end")).withColumn("_left", F.lag("_end").over(outer)).withColumn("_wrap", F.max("_end").over(Window.orderBy(F.lit(1))))
    before = (
        firsts.withColumn("_own", F.lag("_group").over(inner))
        .join(ends.select("_c", "_left", "_wrap"), "_c")
        .select(
            F.col("_group").alias("_g"),
            F.col("_first").alias("_f"),
            F.coalesce("_own", "_left", "_wrap").alias("_to"),
            (F.coalesce("_own", "_left").isNull()).cast("int").alias("_last"),
        )
    )
    if groups.count <= BROADCAST_GROUPS:
        before = F.broadcast(before)
    joined = keyed.join(before, (F.col("_group") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_f")), "left")
    own = F.struct(F.col("_group").alias("g"), F.lit(0).alias("late"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_to").alias("g"), F.col("_last").alias("late"), F.lit(True).alias("copy"))
    spread = joined.withColumn("_p", F.explode(F.when(F.col("_to").isNotNull(), F.array(own, copy)).otherwise(F.array(own))))
    dealt = spread.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_p.g").alias("_to"), F.col("_p.late").alias("_late"), F.col("_p.copy").alias("_copy"))
    by = Window.partitionBy("_to").orderBy("_late", F.col("doc_id").asc_nulls_first(), "_copy", "text")
    ahead = {"next_text": F.lead("text").over(by), "next_fp": F.lead("fingerprint").over(by)}
    return dealt.withColumns(ahead).where(~F.col("_copy")).drop("_to", "_late", "_copy")


def fingerprints(docs: DataFrame, rows_each: int = 1000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the two fingerprints, their likenesses and the changed paragraphs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_tree", tree("text")).withColumn("fingerprint", fingerprint("_tree")).drop("_tree")
    rows = with_next(rows, rows_each)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("_edited", edited).withColumn("_tree", tree("_edited")).withColumn("edited_fingerprint", fingerprint("_tree"))
    rows = rows.withColumns({"_a": leaf_set("fingerprint"), "_b": leaf_set("edited_fingerprint"), "_c": leaf_set("next_fp")})
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", "_a", "_b").alias("near_edited"),
        likeness("fingerprint", "next_fp", "_a", "_c").alias("near_next"),
        F.size(changed_paragraphs("edited_fingerprint", "fingerprint")).cast("long").alias("n_changed_paragraphs"),
    )


def _duck(text: str) -> str:
    marked = f"array_to_string(list_transform(regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}\\n?|\\n'), lambda x: md5(x) || CASE WHEN suffix(x, chr(10)) THEN '/' ELSE '' END), '')"
    return f"array_to_string(list_transform(list_filter(string_split({marked}, '/'), lambda x: x <> ''), lambda x: x || '/' || CASE WHEN left(md5(x), 1) IN ('0', '8') THEN '|' ELSE '' END), '')"


def _duck_fp(t: str) -> str:
    return f"sha256(array_to_string(list_transform(string_split({t}, '|'), lambda s: md5(array_to_string(list_transform(string_split(s, '/'), lambda p: md5(p)), ''))), '')) || ':' || regexp_replace({t}, '([0-9a-f]{{{MARK}}})[0-9a-f]{{{32 - MARK}}}', '\\1', 'g')"


def _duck_like(a: str, b: str, sa: str, sb: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE least(len(list_intersect({sa}, {sb})) * 2.0::DOUBLE / greatest(len({sa}) + len({sb}), 1), 1.0::DOUBLE - 1.0::DOUBLE / (len({sa}) + len({sb}) + 1)) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nt FROM d),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(nt, 1, length(text) // 2) AS ed FROM n),
t AS (SELECT *, {_duck("text")} AS t1, {_duck("ed")} AS t2, {_duck("nt")} AS t3 FROM e),
f AS (SELECT *, {_duck_fp("t1")} AS f1, {_duck_fp("t2")} AS f2, {_duck_fp("t3")} AS f3 FROM t),
s AS (SELECT *, list_distinct(regexp_extract_all(substring(f1, 66), '[0-9a-f]{{{MARK}}}')) AS s1, list_distinct(regexp_extract_all(substring(f2, 66), '[0-9a-f]{{{MARK}}}')) AS s2,
        list_distinct(regexp_extract_all(substring(f3, 66), '[0-9a-f]{{{MARK}}}')) AS s3,
        list_filter(string_split(replace(substring(f2, 66), '|', ''), '/'), lambda x: x <> '') AS p2, string_split(replace(substring(f1, 66), '|', ''), '/') AS p1 FROM f)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, f1 AS fingerprint, f2 AS edited_fingerprint,
  {_duck_like("f1", "f2", "s1", "s2")} AS near_edited, {_duck_like("f1", "f3", "s1", "s3")} AS near_next,
  CAST(len(list_filter(p2, lambda x: NOT list_contains(p1, x))) AS BIGINT) AS n_changed_paragraphs FROM s
"""
