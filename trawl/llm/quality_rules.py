"""Quality rules whose thresholds adapt to each language and source.

Base measures of every text come from array functions of the JVM. Each measure's distribution is kept
per (lang, source) as a mergeable quantile sketch: a histogram over buckets of bounded relative width,
whose counts simply add, so partial sketches merge on the map side and the sketches of a language or of
the corpus are sums of those of its sources. Upper and lower fences are read from the sketches and
joined back to the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.llm.shared import WORD, apart, let, others, stored, together, words_of

#: Words per repeated window.
WINDOW = 5
#: Buckets keep this many leading bits of a value, so their relative width is at most 1/32.
SKETCH_BITS = 6
#: A sketch with fewer texts gives way to its language's, and that to the corpus's; the column fences_of tells which was used.
LEAST_TEXTS = 200
#: Spreads (median to quartile, on the side that faces away from the outliers) between median and fence.
SPREADS = 6
#: Measure, in thousandths: (least upper fence, greatest lower fence as thousandths of the median).
MEASURES = {"symbols_pm": (100, None), "dup_lines_pm": (300, None), "repeats_pm": (150, None), "word_len_pm": (0, 500)}
#: The upper fence of the word length is at least this many times its median.
WORD_LEN_TIMES = 2


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more. Windows are told apart by XXH64."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(hashed: Column) -> Column:
        pairs = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(sorted_pairs: Column) -> Column:
            twice = F.filter(
                sorted_pairs,
                lambda p, k: (p["h"] == F.get(sorted_pairs, k - 1)["h"]) | (p["h"] == F.get(sorted_pairs, k + 1)["h"]),
            )
            starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
            begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
            return F.aggregate(
                starts,
                begin,
                lambda a, s: F.struct((s + WINDOW).alias("end"), (a["sum"] + F.least(F.lit(WINDOW), s + WINDOW - a["end"])).alias("sum")),
                lambda a: a["sum"],
            )

        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))


#: Columns of the result besides those of the documents.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULT = (*BASE, "kept", "n_lines", *MEASURES, "fences_of")


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long, in place of columns of these names."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    long = lambda c, name: c.cast("long").alias(name)
    from_words = let(
        words_of(body),
        lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    from_lines = let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    symbols = F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))
    rest = others(documents.columns, *BASE, "n_lines")
    counted = documents.select(together(rest).alias("row"), from_words.alias("words"), from_lines.alias("lines"), long(symbols, "n_symbols"))
    return counted.select(*apart("row", rest), "words.*", "n_symbols", "lines.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _scaled(part: str, whole: str) -> Column:
    """part / whole in whole thousandths, 0 where there is nothing."""
    return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0)).cast("long")


def _bucket(value: Column) -> Column:
    """The least value with the same SKETCH_BITS leading bits."""
    low = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key values and measure: rows (keys, name, bucket, n)."""
    values = F.array(*[F.struct(F.lit(m).alias("name"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return measured.select(*keys, F.explode(values).alias("v")).groupBy(*keys, "v.name", "v.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys, as sums of finer ones."""
    return sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key values: n_texts, and for each measure its upper and lower fence."""
    group = Window.partitionBy(*keys, "name")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "name").agg(at(25).alias("q1"), at(50).alias("q2"), at(75).alias("q3"), F.max("total").alias("total"))
    high = reduce(lambda c, m: c.when(F.col("name") == m, F.lit(MEASURES[m][0])), MEASURES, F.when(F.lit(False), F.lit(0)))
    high = F.greatest(high, F.when(F.col("name") == "word_len_pm", WORD_LEN_TIMES * F.col("q2")).otherwise(0), F.col("q2") + SPREADS * (F.col("q2") - F.col("q1")))
    low = F.when(F.col("name") == "word_len_pm", F.least(F.expr(f"{MEASURES['word_len_pm'][1]} * q2 div 1000"), F.col("q2") - SPREADS * (F.col("q3") - F.col("q2"))))
    fenced = quartiles.select(*keys, "name", "total", high.alias("high"), low.alias("low"))
    pick = lambda m, c: F.max(F.when(F.col("name") == m, F.col(c)))
    return fenced.groupBy(*keys).agg(
        F.max("total").alias("n_texts"), *[pick(m, "high").alias(f"{m}_high") for m in MEASURES], pick("word_len_pm", "low").alias("word_len_pm_low")
    )


def apply_rules(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``documents`` without the text, with RESULT: the measures, ``base_failed``, ``kept`` and whose fences were used.

    Texts that pass the base rules feed the sketches, and are kept unless a measure lies beyond a fence
    of their language and source (of the language, or the corpus, where fewer than ``least_texts`` texts pass).
    Null languages and sources are groups of their own; null and blank texts have no words and fail the base rules;
    texts are measured whole, however long; repeated rows count as often as they occur; columns named as one of
    RESULT give way to it, and all others are kept, whatever their names; an empty table gives an empty one.
    """
    rest = others(documents.columns, text, *RESULT)
    rows = documents.select(together(rest).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = measure(rows).withColumn("base_failed", base_failed())
    measured = measured.withColumns(
        {
            "symbols_pm": _scaled("n_symbols", "n_words"),
            "dup_lines_pm": _scaled("n_dup_lines", "n_lines"),
            "repeats_pm": _scaled("n_repeat_words", "n_words"),
            "word_len_pm": _scaled("word_chars", "n_words"),
        }
    )
    measured = stored(measured.drop("text"))
    by_source = stored(sketches(measured.filter(~F.col("base_failed")), ["lang", "source"]))
    bounds = ["n_texts", *[f"{m}_high" for m in MEASURES], "word_len_pm_low"]
    named = lambda df, keys, tag: fences(df, keys).select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], *[F.col(b).alias(f"{tag}_{b}") for b in bounds])
    of_source, of_lang = named(by_source, ["lang", "source"], "s"), named(merged(by_source, ["lang"]), ["lang"], "l")
    of_all = fences(merged(by_source, []), []).first()  # one row of six numbers
    table = of_source.join(of_lang, F.col("s_lang").eqNullSafe(F.col("l_lang")))
    enough = lambda tag: F.col(f"{tag}_n_texts") >= least_texts
    chosen = {b: F.when(enough("s"), F.col(f"s_{b}")).when(enough("l"), F.col(f"l_{b}")).otherwise(F.lit(of_all[b])) for b in bounds[1:]}
    level = F.when(enough("s"), "source").when(enough("l"), "lang").otherwise("all").alias("fences_of")
    table = table.select("s_lang", "s_source", level, *[c.alias(f"_{b}") for b, c in chosen.items()])
    fenced = measured.join(table, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    # Values are held against the fences as the sketches know them, by bucket.
    inside = reduce(lambda a, b: a & b, [_bucket(F.col(m)) <= F.col(f"_{m}_high") for m in MEASURES]) & (F.col("word_len_pm") >= F.col("_word_len_pm_low"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return fenced.select(*apart("row", rest), *BASE, kept.alias("kept"), "n_lines", *MEASURES, "fences_of")
