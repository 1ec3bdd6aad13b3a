"""Quality rules with adaptive thresholds (native: DataFrame and SQL functions only).

Every text gets counts from built-in array functions. For each language and source a mergeable quantile sketch of
four ratios and two sizes is kept: a log-linear histogram (64 exact cells, then cells of 1/32 relative width), which is
a plain grouped count. Such sketches merge by adding counts, partial aggregation makes them before the shuffle, and they
come out the same whatever order tasks run in. Small groups use the merged sketch of their language, then of all
documents. Thresholds come from the sketch alone, in which up to a fifth of a group may be junk at either end:

  - Word length stays within LENGTH_FENCE spreads of the group's 20th and 80th percentiles; a spread is what lies
    between these two and a cell's width.
  - Of the ratios that are mostly 0 the 80th percentile and one event in a text of the group's median size make the
    spread; the fence is EVENT_FENCE spreads above the percentile. An event is a symbol, a repeated line, or two
    windows of three words.

So a source with long texts gets lower limits than one with short texts, and one that uses symbols gets higher limits
than one that doesn't. Limits are joined back to the rows.

Null text or an empty one has no words, so it fails the base rule. Null language or source is a group of its own.
Repeated rows and rows with one id are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrewell.llm.common import durable

BLANK = r"[\x20\x09-\x0D]+"
METRICS = ("q_len", "q_sym", "q_dup", "q_rep")
#: For each ratio of events: the size it refers to, and an event in thousandths.
EVENTS = {"q_sym": ("n_words", 1000), "q_dup": ("n_lines", 1000), "q_rep": ("n_words", 6000)}
SIZES = ("n_words", "n_lines")
LENGTH_FENCE, EVENT_FENCE = 4, 20
LEAST_ROWS = 64

_REPEATS = """
element_at(transform(array(_words), w -> CASE WHEN size(w) < 3 THEN 0L ELSE
  element_at(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
      element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
        aggregate(
          sort_array(filter(
            transform(s, (x, k) -> CASE WHEN (k > 0 AND x.h = s[k - 1].h)
                                          OR (k < size(s) - 1 AND x.h = s[k + 1].h) THEN x.i END),
            y -> y IS NOT NULL)),
          struct(0L AS t, -3 AS l),
          (a, x) -> struct(a.t + least(3, x - a.l) AS t, x AS l),
          a -> a.t)), 1) END), 1) END), 1)
"""


def add_counts(docs: DataFrame) -> DataFrame:
    """The docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and the four ratios."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(text, BLANK), "")).withColumn("_lines", lines)
    n, n_lines = F.size("_words").cast("long"), F.size("_lines").cast("long")
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
    )
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "q_len": F.expr("word_chars * 100 div greatest(n_words, 1)"),
            "q_sym": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
            "q_dup": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
            "q_rep": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        }
    )


def sketch(counted: DataFrame) -> DataFrame:
    """lang, source, metric, cell, n: the histograms of the rows that the base rule keeps."""
    # a filter on base_failed itself would be pushed below the counts and make them twice
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(~F.col("base_failed"), F.col(m)).alias("v")) for m in (*METRICS, *SIZES)]))
    rows = counted.select("lang", "source", cells.alias("c")).where("c.v IS NOT NULL")
    shift = F.expr("greatest(length(bin(c.v)) - 6, 0)")
    return (
        rows.select("lang", "source", "c.metric", F.expr("c.v AS v"), shift.alias("shift"))
        .select("lang", "source", "metric", F.expr("shiftleft(shiftright(v, shift), shift)").alias("cell"))
        .groupBy("lang", "source", "metric", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    by = Window.partitionBy(*keys, "metric")
    ranked = (
        cells.groupBy(*keys, "metric", "cell")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(by.orderBy("cell")))
        .withColumn("total", F.sum("n").over(by))
    )
    picked = [F.max("total").alias(f"{prefix}_n")]
    wanted = [(m, q, tenths) for m in METRICS for q, tenths in (("lo", 2), ("hi", 8))] + [(m, "mid", 5) for m in SIZES]
    for m, q, tenths in wanted:
        there = (F.col("metric") == m) & (F.col("upto") * 10 >= F.col("total") * tenths)
        picked.append(F.min(F.when(there, F.col("cell"))).alias(f"{prefix}_{m}_{q}"))
    return ranked.groupBy(*keys).agg(*picked)


def thresholds(cells: DataFrame) -> DataFrame:
    """lang, source and the fences of each group, from its own sketch or the merged one of its language or of all."""
    own = _quantiles(cells, ["lang", "source"], "g")
    lang = _quantiles(cells, ["lang"], "l").withColumnRenamed("lang", "l_lang")
    everything = _quantiles(cells, [], "a")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(everything))

    def level(name: str) -> Column:
        return F.when(F.col("g_n") >= LEAST_ROWS, F.col(f"g_{name}")).when(F.col("l_n") >= LEAST_ROWS, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}"))

    picked = {f"{m}_{q}": level(f"{m}_{q}") for m in METRICS for q in ("lo", "hi")} | {f"{m}_mid": level(f"{m}_mid") for m in SIZES}
    groups = joined.select("lang", "source", *[c.alias(name) for name, c in picked.items()])
    spread = f"{LENGTH_FENCE} * (q_len_hi - q_len_lo + q_len_hi div 32)"
    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.expr(f"q_len_lo - {spread}").alias("_q_len_min"), F.expr(f"q_len_hi + {spread}").alias("_q_len_max")]
    out += [F.expr(f"{m}_hi + {EVENT_FENCE} * {m}_hi + {EVENT_FENCE * event} div greatest({of}_mid, 1)").alias(f"_{m}_max") for m, (of, event) in EVENTS.items()]
    return groups.select(*out)


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """Rows with kept: the joined filter. The low fence holds for word length only."""
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.col("q_len") >= F.col("_q_len_min")
    for m in METRICS:
        inside = inside & (F.col(m) <= F.col(f"_{m}_max"))
    rows = counted.join(fences, on, "left")
    # one difference, so that no half of it is pushed below the counts
    kept = F.coalesce(inside, F.lit(True)).cast("int") - F.coalesce(F.col("base_failed"), F.lit(False)).cast("int") > 0
    return rows.withColumn("kept", kept).drop(*fences.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of each row; texts are read once."""
    counted = durable(add_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judge(counted, thresholds(sketch(counted)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with docs' own columns.

    The rows are written with their counts, so that texts are counted once and not moved: limits come to them.
    """
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "lang", "source", "text")}
    plain = docs.withColumnsRenamed(names)
    counted = durable(add_counts(plain), "quality")
    kept = judge(counted, durable(thresholds(sketch(counted)), "fences")).where("kept").select(*plain.columns)
    return kept.withColumnsRenamed({v: k for k, v in names.items()})


ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
g AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM p) WHERE c >= 2),
r AS (SELECT rid, count(DISTINCT j) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN r ON w.rid = r.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        word_chars * 100 // greatest(n_words, 1) AS q_len, n_symbols * 1000 // greatest(n_words, 1) AS q_sym,
        n_dup_lines * 1000 // greatest(n_lines, 1) AS q_dup, n_repeat_words * 1000 // greatest(n_words, 1) AS q_rep FROM m),
v AS (SELECT lang, source, metric, v FROM (SELECT lang, source, CAST(q_len AS BIGINT) AS q_len, CAST(q_sym AS BIGINT) AS q_sym, CAST(q_dup AS BIGINT) AS q_dup, CAST(q_rep AS BIGINT) AS q_rep, n_words, n_lines FROM b WHERE NOT base_failed)
      UNPIVOT (v FOR metric IN (q_len, q_sym, q_dup, q_rep, n_words, n_lines))),
c AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS cell, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT 0 AS lv, lang, source, metric, cell, n FROM c UNION ALL
      SELECT 1, lang, NULL, metric, cell, sum(n) FROM c GROUP BY ALL UNION ALL
      SELECT 2, NULL, NULL, metric, cell, sum(n) FROM c GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, metric) AS total FROM s),
q AS (SELECT lv, lang, source, metric, max(total) AS n, min(cell) FILTER (upto * 10 >= total * 2) AS lo, min(cell) FILTER (upto * 10 >= total * 8) AS hi, min(cell) FILTER (upto * 10 >= total * 5) AS mid FROM u GROUP BY ALL),
k AS (SELECT g.lang, g.source, g.metric,
        {", ".join(f"CASE WHEN g.n >= {LEAST_ROWS} THEN g.{x} WHEN l.n >= {LEAST_ROWS} THEN l.{x} ELSE a.{x} END AS {x}" for x in ("lo", "hi", "mid"))}
      FROM (SELECT * FROM q WHERE lv = 0) g JOIN (SELECT * FROM q WHERE lv = 1) l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric
      JOIN (SELECT * FROM q WHERE lv = 2) a ON g.metric = a.metric),
p2 AS (SELECT lang, source, {", ".join(f"max({x}) FILTER (metric = '{m}') AS {m}_{x}" for m in (*METRICS, *SIZES) for x in ("lo", "hi", "mid"))} FROM k GROUP BY ALL),
f AS (SELECT lang, source, q_len_lo - {LENGTH_FENCE} * (q_len_hi - q_len_lo + q_len_hi // 32) AS q_len_min, q_len_hi + {LENGTH_FENCE} * (q_len_hi - q_len_lo + q_len_hi // 32) AS q_len_max,
        {", ".join(f"{m}_hi + {EVENT_FENCE} * {m}_hi + {EVENT_FENCE * event} // greatest({of}_mid, 1) AS {m}_max" for m, (of, event) in EVENTS.items())} FROM p2)
SELECT doc_id, b.lang, b.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, CAST(q_len AS BIGINT) AS q_len, CAST(q_sym AS BIGINT) AS q_sym,
  CAST(q_dup AS BIGINT) AS q_dup, CAST(q_rep AS BIGINT) AS q_rep,
  NOT base_failed AND coalesce(q_len >= q_len_min AND {" AND ".join(f"{m} <= {m}_max" for m in METRICS)}, true) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
