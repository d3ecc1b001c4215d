"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words. Its documents get expected copies that add up to the target, shorter
ones a few more than longer ones, none above the limit. The whole part of that number is certain; the rest
is an inclusion probability p. Documents are ranked by random odds divided by inclusion odds,
(u / (1 - u)) / (p / (1 - p)), with u from a hash of the id, and the first are taken until the words still
missing are there: a sample of fixed size in words, with unequal probabilities.

Only the place where a source's words run out has to be found: sums over a histogram of the ranks name the
bucket it lies in, sums over a finer histogram of that bucket the next, and only the few documents there are put in
order. All others are taken or left by comparing their rank with it, so documents are never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.llm.shared import apart, joined, stored, together, words_of

#: Weights of the sources by code point, repeating, and the most copies of a source or document.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix"
#: Buckets of a histogram of ranks.
BUCKETS = 4096


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): shares of all words by weight, at most MOST times a source's words.

    Sources that stop at their limit leave their excess to the others by weight. Ordered by limit over
    weight, those before some place stop and the others share what is left, so running sums find the place.
    The table has one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), rank % len(WEIGHTS) + 1))
    order = Window.orderBy(F.expr("source_size * 10 div weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.withColumns(
        {
            "limit": MOST * F.col("source_size"),
            "total": F.sum("source_size").over(everywhere),
            "stopped": F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0)),
            "weights": F.sum("weight").over(from_here),
            "place": F.row_number().over(order),
        }
    ).withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / F.col("weights").cast("double"))
    first = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("place"))).over(everywhere)
    return filled.select("source", "source_size", F.least(F.col("limit").cast("double"), first * F.col("weight")).alias("target"))


def _preference() -> Column:
    """How many copies a size class gets against others: fewer the longer."""
    return F.expr("1024 div (8 + class)")


def expected_copies(classes: DataFrame) -> DataFrame:
    """Adds ``expected`` to rows (source, class, n, words, target): copies of the class's documents.

    Within a source, copies are in proportion to the preference and at most MOST, and their words add up to
    the target; classes are ordered by preference, and running sums find those that stop at the limit.
    Also ``missing``: the words of the source's target that whole copies leave.
    """
    by = Window.partitionBy("source")
    order = by.orderBy("class")
    scored = classes.withColumn("preference", _preference()).withColumns(
        {
            "stopped": F.coalesce(MOST * F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "shares": F.sum(F.col("words") * F.col("preference")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    scored = scored.withColumn("level", (F.col("target") - F.col("stopped").cast("double")) / F.col("shares").cast("double"))
    fits = F.col("level") * F.col("preference") <= MOST
    scored = scored.withColumn("first", F.min(F.when(fits, F.col("class"))).over(by))
    scored = scored.withColumn("level", F.max(F.when(F.col("class") == F.col("first"), F.col("level"))).over(by))
    expected = F.when(F.col("class") >= F.col("first"), F.least(F.lit(float(MOST)), F.col("level") * F.col("preference"))).otherwise(F.lit(float(MOST)))
    scored = scored.withColumn("expected", expected)
    whole = F.sum(F.floor("expected") * F.col("words")).over(by)
    rest = F.sum(F.when(F.col("expected") > F.floor("expected"), F.col("n")).otherwise(0)).over(by)
    return scored.select("source", "source_size", "target", "class", "expected", (F.col("target") - whole.cast("double")).alias("missing"), rest.alias("candidates"))


def _rows(documents: DataFrame, doc_id: str, text: str, source: str, keep: list[str]) -> DataFrame:
    """Rows (row, doc_id, source, size, class, u): u from id and text, so that only equal rows share one."""
    name = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))), F.lit(SEED))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    size = F.size(words_of(F.col(text))).cast("long")
    rows = documents.select(together(keep).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), u.alias("u"))
    return rows.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns, ``whole`` copies, and ``odds``, the rank among candidates (null where nothing is drawn)."""
    known = joined(rows, plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))).drop("_source", "_class")
    p, whole = F.col("expected") - F.floor("expected"), F.floor("expected")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return known.withColumns({"whole": whole, "odds": F.when(p > 0, odds)})


def _crossing(drawn: DataFrame, key: Column, missing: Column, before: Column) -> DataFrame:
    """Rows (_source, _key, _before) of the least ``key`` of each source at which its words, from ``before`` on, pass ``missing``."""
    sums = drawn.groupBy("source", key.alias("key")).agg(F.sum("size").alias("words"), F.first(missing).alias("missing"), F.first(before).alias("start"))
    upto = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    passed = sums.withColumn("upto", upto).filter("upto > missing")
    return passed.groupBy("source").agg(F.min_by(F.struct("key", (F.col("upto") - F.col("words")).alias("before")), "key").alias("at")).select(
        F.col("source").alias("_source"), F.col("at.key").alias("_key"), F.col("at.before").alias("_before")
    )


def _step(power: int) -> Column:
    """The bucket of a rank in a histogram of BUCKETS ** power."""
    share = F.col("odds") / (1 + F.col("odds"))
    return F.floor(share * float(BUCKETS**power))


def _cuts(drawn: DataFrame) -> DataFrame:
    """Rows (_source, odds, size, doc_id, k, n): the last place in each source's order at which something is taken.

    Documents before it are taken; of the ``n`` equal rows at it ``k`` are (none, some or all). A source all of whose
    candidates are taken has no row.
    """
    found = drawn.withColumn("_before", F.lit(0).cast("long"))
    for power in (1, 2):
        crossing = stored(_crossing(found, _step(power), F.col("missing"), F.col("_before")))
        found = stored(joined(found.drop("_before"), crossing, F.col("source").eqNullSafe(F.col("_source")) & (_step(power) == F.col("_key"))).drop("_source", "_key"))
    order = ["odds", "size", "doc_id"]
    places = found.groupBy("source", *order).agg(F.count("*").alias("n"), F.first("missing").alias("missing"), F.first("_before").alias("start"))
    before = F.col("start") + F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy(*order)) - F.col("n") * F.col("size")
    # A document is taken if that brings the sum closer: if half of it still fits.
    k = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((2 * F.col("missing") - 2 * F.col("before") + F.col("size")) / (2 * F.col("size")))))
    counted = places.withColumn("before", before).withColumn("k", k.cast("long"))
    at, place = F.struct(*order, "k", "n"), F.struct(*order)
    first = F.min_by(F.when(F.col("k") < F.col("n"), at), F.when(F.col("k") < F.col("n"), place))
    first = counted.groupBy("source").agg(F.coalesce(first, F.max_by(at, place)).alias("at"))
    return first.select(F.col("source").alias("_source"), F.struct(*[F.col(f"at.{c}").alias(c) for c in order]).alias("_cut"), F.col("at.k").alias("_k"), F.col("at.n").alias("_n"))


def plan(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of ``_rows``: a row for each source and size class, and the cut of each source's order."""
    classes = stored(slim.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    aimed = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "_source")
    both = classes.join(aimed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    with_words = expected_copies(both.filter("class > 0"))
    without = both.filter("class = 0").select(
        "source", "source_size", "target", "class", F.lit(0.0).alias("expected"), F.lit(0.0).alias("missing"), F.lit(0).cast("long").alias("candidates")
    )
    shares = stored(with_words.unionByName(without).drop("candidates")).withColumnsRenamed({"source": "_source", "class": "_class"})
    drawn = _planned(slim, shares).filter("odds is not null").select("source", "size", "doc_id", "odds", "missing")
    return shares, stored(_cuts(drawn))


def _taken(rows: DataFrame, shares: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``copies``. Only where some of several equal rows are taken are those numbered, in two levels."""
    known = joined(_planned(rows, shares), cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    place = F.struct("odds", "size", "doc_id")
    extra = F.when(F.col("odds").isNull(), 0).when(F.col("_cut").isNull() | (place < F.col("_cut")) | ((place == F.col("_cut")) & (F.col("_k") == F.col("_n"))), 1).otherwise(0)
    known = known.withColumn("copies", (F.col("whole") + extra).cast("long"))
    if cuts.filter("0 < _k and _k < _n").isEmpty():
        return known
    some = F.coalesce((F.col("_k") > 0) & (F.col("_k") < F.col("_n")) & (place == F.col("_cut")), F.lit(False))
    equal = stored(known.filter(some).withColumn("part", F.spark_partition_id()))
    counts = equal.groupBy("source", "part").agg(F.count("*").alias("count"))
    upto = F.sum("count").over(Window.partitionBy("source").orderBy("part")) - F.col("count")
    counts = stored(counts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), upto.alias("earlier")))
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("copies"))
    numbered = joined(equal.withColumn("within", within), counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    copies = F.col("copies") + (F.col("earlier") + F.col("within") <= F.col("_k")).cast("long")
    return known.filter(~some).unionByName(numbered.withColumn("copies", copies).select(known.columns))


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies), one for each document.

    A null source is a source, the last one; null texts have no words, and documents without words are
    taken zero times; texts are counted whole, however long. Rows without an id, or with the same one, are told
    apart by their texts; rows equal in both are taken each for itself, and which of them is taken makes no
    difference. Other columns, whatever their names, are left out. An empty table gives an empty one. Reruns agree,
    as the random numbers come from ids and texts.
    """
    slim = stored(_rows(documents, doc_id, text, source, []).drop("row"))
    found = _taken(slim, *plan(slim))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``documents``, each as often as ``mix`` takes it; documents are only read, never shuffled."""
    slim = stored(_rows(documents, doc_id, text, source, []).drop("row"))
    found = _taken(_rows(documents, doc_id, text, source, documents.columns), *plan(slim)).filter("copies > 0")
    each = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(*apart("row", documents.columns))
