"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source, then joined filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.llm.common import SPACE, gram_hashes, map_arrow, saved, small_join, texts, word_hashes

#: Contract limits of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Sketch buckets hold values to 1/32 of their size. A fence lies this many spreads (50th less 10th percentile, which junk at the upper end cannot widen) beyond the median.
BUCKET_BITS, SPREADS = 5, 8
#: Weight of the language's fence, in documents, against the fence of a language and source.
PRIOR_DOCS = 200
#: Metrics in integer shares, and the least room between median and fence, so that uniform groups keep ordinary documents.
METRICS = {"symbol_rate": 60, "dup_line_rate": 250, "repeat_rate": 100, "word_length": 400}
#: Where a metric ends, or the base rule takes over: a fence goes half the way from the median at most, so that it always rejects something.
BOUNDS = {"symbol_rate": 1000, "dup_line_rate": 1000, "repeat_rate": 10 * MAX_REPEAT_PERCENT}
#: The base rule's failures.
FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
SYMBOLS = b"#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: bytes) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    buf = np.frombuffer(text, np.uint8)
    words = word_hashes(text)
    chars = int(((buf & 0xC0) != 0x80).sum() - SPACE[buf].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        grams = gram_hashes(words, WINDOW)
        order = np.argsort(grams)
        same = np.diff(grams[order]) == 0
        if same.any():
            twice = np.zeros(len(grams), bool)
            twice[order[:-1][same]] = twice[order[1:][same]] = True
            at = np.flatnonzero(twice)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    return [len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns and the measures of each text, with metrics as integer shares (null where there are no words)."""
    names = [*NAMES, "n_lines"]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(x) for x in texts(batch, text)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, rows.T.copy())], names=[*keep, *names])

    m = map_arrow(docs.select(*keep, text), run, schema)
    return m.withColumns({
        "symbol_rate": F.expr("if(word_chars > 0, 1000 * n_symbols div word_chars, null)"),
        "dup_line_rate": F.expr("if(n_lines > 0, 1000 * n_dup_lines div n_lines, null)"),
        "repeat_rate": F.expr("if(n_words > 0, 1000 * n_repeat_words div n_words, null)"),
        "word_length": F.expr("if(n_words > 0, 100 * word_chars div n_words, null)"),
    })


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: exact below 2**(BUCKET_BITS + 1), then BUCKET_BITS bits after the first."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - (BUCKET_BITS + 1))
    step = F.pow(F.lit(2), shift).cast("long")
    return value - value % step


def fences(m: DataFrame, group: list[str]) -> DataFrame:
    """Upper fence of each metric for each group: quantiles of merged bucket counts of the documents that pass the base rule.

    The sketch of a group is its counts by bucket. Counts of parts add up, so they merge in any order to the same
    sketch; Spark adds them before the shuffle, and a hot group is a few hundred rows like any other.
    """
    long = m.filter(f"not {FAILED}").select(*group, F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in METRICS))).alias("__m")).select(*group, "__m.metric", bucket(F.col("__m.value")).alias("__b"))
    counts = long.groupBy(*group, "metric", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group, "metric")
    counts = counts.withColumn("__up", F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    at = lambda percent: F.min(F.when(F.col("__up") * 100 >= F.col("__all") * percent, F.col("__b")))
    q = counts.groupBy(*group, "metric").agg(at(10).alias("__q10"), at(50).alias("__q50"), F.first("__all").alias("__all"))
    least = reduce(lambda a, x: a.when(F.col("metric") == x, METRICS[x]), METRICS, F.when(F.lit(False), 0))
    bound = reduce(lambda a, x: a.when(F.col("metric") == x, BOUNDS[x]), BOUNDS, F.when(F.lit(False), 0))
    room = F.least(F.greatest(SPREADS * (F.col("__q50") - F.col("__q10")), least), F.floor((bound - F.col("__q50")) / 2))  # least() skips the null of no bound
    return q.select(*group, "metric", "__all", (F.col("__q50") + room).alias("__fence"))


def judge(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason.

    A document is kept if the base rule holds and none of its metrics passes the fence of its language and source,
    which leans to the language's fence by PRIOR_DOCS documents. Null texts have no words and fail the base rule;
    null languages and sources are groups of their own; repeated ids are judged alike, row by row. An empty table gives
    no row; other columns are not read. A text is measured whole, in one task, with some 60 bytes of memory for each
    of its bytes.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("~")).alias("lang"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~")).alias("source"), F.col(text).alias("text"))
    m = saved(measured(d), "measures")
    own, whole = fences(m, ["lang", "source"]), fences(m, ["lang"]).select("lang", "metric", F.col("__fence").alias("__wide"))
    both = own.join(whole, ["lang", "metric"]).select("lang", "source", "metric", F.expr(f"(__all * __fence + {PRIOR_DOCS} * __wide) div (__all + {PRIOR_DOCS})").alias("__limit"))
    limits = saved(both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == x, F.col("__limit"))).alias(f"__{x}") for x in METRICS)), "limits")
    j = small_join(m, limits, ["lang", "source"], "left")
    failed = F.expr(FAILED)
    reason = reduce(lambda a, x: a.when(F.col(x) > F.col(f"__{x}"), F.lit(x)), METRICS, F.when(failed, F.lit("base")))
    return j.select("doc_id", *NAMES, failed.alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))
