"""Quality rules with adaptive thresholds (operator 1, DataFrame functions only).

Per document, counts over the whole text; per language and source, a
mergeable quantile sketch of each ratio; fences from the sketch's quartiles
replace fixed cutoffs; documents are judged by a join with the fences.

The sketch is a histogram of fixed resolution: a ratio is scaled to an
integer (see ``METRICS``), clamped at ``CLAMP``, and counted, so a sketch
has at most ``CLAMP + 1`` counters however many documents it has seen, its
quantiles are exact to one step, and sketches merge by adding counters
(partial aggregation does that before the shuffle; language-wide and global
sketches are sums of the source sketches).  It is deterministic, unlike
sketches that keep random samples, so a repeated task gives the same fences.

Every document with a defined ratio feeds its group's sketch, also those
that fail the base rule.  The upper fence is ``q75`` plus the larger of ``reach``
times the quartile distance and ``tail`` percent of the distance from ``q75``
to a high quantile, which alone speaks where most documents agree (no symbols,
no repeated lines); word length has a lower fence as well.  Where both
distances are zero those of the language's sketch count, then those of all
documents.  Groups
with fewer than ``min_rows`` documents use the fences of their language, then
of all.

Defined results: null text has no words and fails the base rule; null
``lang`` or ``source`` are groups of their own; repeated rows are judged one
by one; an empty table gives an empty result; extra columns are ignored; very
long texts are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstat.llm.common import let, materialise, pack, words

CLAMP = 10_000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Metric:
    """``scale * numerator / denominator`` in whole steps; fences as above,
    ``high`` in percent; ``low`` also fences below the quartile."""
    name: str
    numerator: str
    denominator: str
    scale: int
    reach: int = 3
    high: int = 95
    tail: int = 0
    low: bool = False


# Parameters: resolution and fences of each ratio.
METRICS = (
    Metric("word_length", "word_chars", "n_words", 100, reach=4, low=True),             # hundredths of a character
    Metric("symbols", "n_symbols", "word_chars", 10_000, high=95, tail=20),             # share of word characters
    Metric("dup_lines", "n_dup_lines", "n_lines", 10_000, high=98, tail=100),           # share of lines
    Metric("repeats", "n_repeat_words", "n_words", 10_000, high=95, tail=100),          # share of words
)
MIN_ROWS = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared as text.  Only a text with a repeated window sorts
    (window, position) pairs; equal neighbours give the repeated positions,
    and the union of ``[p, p + 2]`` over the sorted positions is counted.
    """
    def windows(a: Column) -> Column:
        return F.transform(
            F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 2).alias("a"), F.slice(a, F.lit(2), F.size(a) - 2).alias("b"),
                         F.slice(a, F.lit(3), F.size(a) - 2).alias("c")),
            lambda s: F.concat_ws(" ", s["a"], s["b"], s["c"]))

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("w"), i.alias("p"))))

        def positions(s: Column) -> Column:
            equal = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False)))
            flagged = F.arrays_zip(s.alias("s"), equal.alias("next"),
                                   F.concat(F.array(F.lit(False)), equal).alias("prev"))
            return F.sort_array(F.transform(
                F.filter(flagged, lambda f: F.coalesce(f["next"], F.lit(False)) | F.coalesce(f["prev"], F.lit(False))),
                lambda f: f["s"]["p"]))

        def width(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, F.lit(2), F.size(p)), p, lambda nxt, x: F.coalesce(F.least(nxt - x, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

        return let(ordered, lambda s: let(positions(s), width))

    return (F.when(F.size(w) < 4, F.lit(0).cast("bigint"))
            .otherwise(let(windows(w), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win),
                                                          F.lit(0).cast("bigint")).otherwise(covered(win)))))


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``_row`` (the columns of ``keep``) and the base counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(pack(docs.select(*[f"`{c}`" for c in keep])), F.col("lang").alias("_lang"),
                       F.col("source").alias("_source"), text.alias("_text"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", ""))
    counted = base.select(
        "_row", "_lang", "_source",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"))
    return counted.select(
        "_row", "_lang", "_source", "n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"),
        "n_repeat_words", F.col("_l.n").alias("n_lines"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .alias("base_failed"))


def _step(m: Metric) -> Column:
    """The metric in whole steps; null where the denominator is zero."""
    scaled = F.expr(f"CASE WHEN {m.denominator} > 0 THEN ({m.scale} * {m.numerator}) DIV {m.denominator} END")
    return F.least(scaled, F.lit(CLAMP).cast("bigint"))


def sketches(counted: DataFrame) -> DataFrame:
    """Counters per group and metric: ``_lang, _source, metric, step, n``."""
    long = (counted.select("_lang", "_source", F.explode(F.array(*[
                F.struct(F.lit(m.name).alias("metric"), _step(m).alias("step")) for m in METRICS])).alias("m"))
            .select("_lang", "_source", "m.metric", "m.step").filter(F.col("step").isNotNull()))
    return long.groupBy("_lang", "_source", "metric", "step").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per level and group with the lower and upper fence of each
    metric in steps: level 0 a language and source, 1 a language, 2 all."""
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("_lang").alias("l"), F.col("_source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("_lang").alias("l"), F.lit(None).cast("string").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s"))))
    merged = (sketch.select(level.alias("k"), "metric", "step", "n")
              .groupBy("k.level", "k.l", "k.s", "metric", "step").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("level", "l", "s", "metric")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                           F.sum("n").over(group).alias("total"))
    high = F.element_at(F.create_map(*[x for m in METRICS for x in (F.lit(m.name), F.lit(m.high))]), F.col("metric"))
    quartiles = ranked.withColumn("high", high).groupBy("level", "l", "s", "metric").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("step"))).alias("q25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("step"))).alias("q75"),
        F.min(F.when(100 * F.col("upto") >= F.col("high") * F.col("total"), F.col("step"))).alias("qh"),
        F.max("total").alias("total"))
    spread = quartiles.withColumns({"iqr": F.nullif(F.col("q75") - F.col("q25"), F.lit(0)), "tail": F.nullif(F.col("qh") - F.col("q75"), F.lit(0))})
    wider = [spread.filter(F.col("level") == n).select(*([F.col("l").alias("l1")] if n == 1 else []), F.col("metric").alias(f"m{n}"),
                                                       F.col("iqr").alias(f"iqr{n}"), F.col("tail").alias(f"tail{n}")) for n in (1, 2)]
    # the second is one row per metric
    quartiles = (spread.join(wider[0], (F.col("level") < 2) & F.col("l").eqNullSafe(F.col("l1")) & (F.col("metric") == F.col("m1")), "left")
                 .join(F.broadcast(wider[1]), F.col("metric") == F.col("m2"), "left"))
    own, by_lang = F.col("iqr").isNotNull() | F.col("tail").isNotNull(), F.col("iqr1").isNotNull() | F.col("tail1").isNotNull()
    quartiles = quartiles.withColumns({x: F.coalesce(F.when(own, F.col(x)).when(by_lang, F.col(f"{x}1")).otherwise(F.col(f"{x}2")), F.lit(0))
                                       for x in ("iqr", "tail")})
    cols = []
    for m in METRICS:
        is_m = F.col("metric") == m.name
        up = F.greatest(m.reach * F.col("iqr"), F.expr(f"{m.tail} * tail DIV 100"))
        cols.append(F.max(F.when(is_m, F.col("q75") + up)).alias(f"{m.name}_high"))
        if m.low:
            cols.append(F.max(F.when(is_m, F.col("q25") - m.reach * F.col("iqr"))).alias(f"{m.name}_low"))
    return quartiles.groupBy("level", "l", "s").agg(F.max("total").alias("rows"), *cols)


def judge(counted: DataFrame, fence: DataFrame) -> DataFrame:
    """Adds ``kept``.  A missing fence (no document to learn from) passes."""
    bounds = [c for c in fence.columns if c not in ("level", "l", "s", "rows")]
    own = fence.filter((F.col("level") == 0) & (F.col("rows") >= MIN_ROWS)).select("l", "s", F.struct(*bounds).alias("_own"))
    lang = fence.filter((F.col("level") == 1) & (F.col("rows") >= MIN_ROWS)).select(F.col("l").alias("l1"), F.struct(*bounds).alias("_by_lang"))
    every = fence.filter(F.col("level") == 2).select(F.struct(*bounds).alias("_all"))
    # one row (an aggregate without groups keeps it that way for the planner)
    every = every.agg(F.max("_all").alias("_all"))
    joined = (counted
              .join(own, F.col("_lang").eqNullSafe(F.col("l")) & F.col("_source").eqNullSafe(F.col("s")), "left")
              .join(lang, F.col("_lang").eqNullSafe(F.col("l1")), "left")
              .join(F.broadcast(every), F.lit(True), "left"))
    f = F.coalesce("_own", "_by_lang", "_all")
    ok = F.lit(True)
    for m in METRICS:
        step = _step(m)
        ok = ok & F.coalesce(step <= f[f"{m.name}_high"], F.lit(True))
        if m.low:
            ok = ok & F.coalesce(step >= f[f"{m.name}_low"], F.lit(True))
    return joined.select("_row", *[c for c in counted.columns if c not in ("_row", "_lang", "_source")],
                         (~F.col("base_failed") & ok).alias("kept"))


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns of ``keep``, all by default), the base counts,
    ``base_failed`` and ``kept`` of every document."""
    counted = materialise(with_counts(docs, keep or docs.columns), "quality-counts")
    fence = materialise(fences(sketches(counted)).coalesce(1), "quality-fences")
    return judge(counted, fence)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return quality_rules(docs).filter("kept").select("_row.*")
