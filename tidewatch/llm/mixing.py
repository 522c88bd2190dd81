"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most`` copies. Among all rates that
meet each source's token target, entropy balancing takes those closest to one
copy each. The convex dual has one multiplier per source, and the optimum is the
exponential tilt ``most * sigmoid(shift + multiplier * size / mean size)``. Newton
steps on the dual are Spark aggregations over (source, size class), so a step
costs one small shuffle whatever the corpus holds. Rates then become whole
copies by carrying the rounding error along the size classes of a source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, release, row_hash

#: Up to this many source states, they are broadcast to the size classes; beyond, Spark joins by source.
BROADCAST_SOURCES = 100_000
#: Up to this many size classes with their cuts (some 100 bytes each), they are broadcast.
BROADCAST_CLASSES = 1 << 19
#: Repeats of one row that a task writes.
LOT_ROWS = 4096
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The size with 10 significant bits: at most 1024 classes below 1024, 512 for each doubling above."""
    bits = F.greatest(F.lit(0), F.length(F.bin(size)) - 10)
    return F.call_function("shiftleft", F.call_function("shiftright", size, bits), bits)


def _numbered(by_source: DataFrame) -> DataFrame:
    """Adds ``turn``, the place of each source (by code point, null last) from 0; ranges are sorted apart, their counts carried."""
    key = F.col("source").asc_nulls_last()
    dealt = materialise(by_source.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shuffle partition
    bases = dealt.groupBy("range").agg(F.count("*").alias("held")).select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return dealt.join(F.broadcast(bases), "range").withColumn("turn", F.col("base") + place - 1).drop("range", "base")


def source_targets(classes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: weighted shares of ``share`` times all words, none above ``most`` times its size.

    Sources go by code point, null last, and take the weights in turn. The excess
    of full sources is reshared by weight until none is above its limit: a level L
    with ``target = min(limit, L * weight)``. Each round is one aggregation over the
    sources, and L rises until no further source is full.
    """
    by_source = classes.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("n_docs"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    weighed = materialise(_numbered(by_source).withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most)), "mix-weights")
    level, n_full = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if sums[0] is None or not sums[2] or sums[3] == n_full:
            break
        n_full, level = sums[3], max(level, (sums[0] * float(share) - (sums[1] or 0.0)) / sums[2])
    if sums[0] is not None and not sums[2]:
        level = float("inf")
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _rate(most: float) -> Column:
    """Rate of a class of mean size ``x`` (in means of its source) under multiplier ``lam``; full sources take all copies."""
    tilt = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("lam") * F.col("x")))
    return F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most))).otherwise(F.lit(float(most)) / (1 + F.exp(-(F.lit(-math.log(most - 1)) + tilt))))


def balance(classes: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``rate`` to the classes: Newton on the dual, kept inside a bracket that every step narrows.

    A source is done when its words are within ``tolerance`` of the target, or its
    bracket is too narrow for doubles. Sources that are not done after ``rounds`` raise.

    The gradient of a source is its taken words minus its target, the Hessian
    the sum of ``tokens * x * rate * (1 - rate / most)``; both grow with the
    multiplier, so a step that leaves the bracket is replaced by its middle.
    """
    cols = ["source", "source_size", "n_docs", "target"]
    goal = F.col("target") / F.greatest(F.col("source_size").cast("double"), F.lit(1.0)) / most
    start = F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), goal)) / (1 - F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), goal))))
    state = materialise(targets.select(*cols, (start + math.log(most - 1)).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("miss")), "mix-state")
    small = state.count() <= BROADCAST_SOURCES

    def joined(state: DataFrame) -> DataFrame:
        side = state.withColumnRenamed("source", "of")
        x = F.when(F.col("source_size") > 0, F.col("tokens") / F.col("n") / (F.col("source_size") / F.col("n_docs"))).otherwise(F.lit(0.0))
        return classes.join(F.broadcast(side) if small else side, classes["source"].eqNullSafe(F.col("of"))).withColumn("x", x)

    for _ in range(rounds):
        rate = _rate(most)
        sums = (
            joined(state)
            .withColumn("rate", rate)
            .groupBy("source", *cols[1:], "lam", "lo", "hi")
            .agg(F.sum(F.col("tokens") * F.col("rate")).alias("got"), F.sum(F.col("tokens") * F.col("x") * F.col("rate") * (1 - F.col("rate") / most)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.when(F.col("slope") > 0, gap / F.col("slope")).otherwise(F.lit(0.0))
        fixed = (F.col("target") >= F.col("source_size") * most) | (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (hi - lo <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam")))
        old, state = state, materialise(
            sums.select(
                *cols,
                F.when(fixed, F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2).alias("lam"),
                lo.alias("lo"),
                hi.alias("hi"),
                F.when(fixed, F.lit(0.0)).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))).alias("miss"),
            ),
            "mix-state",
        )
        release(old)
        if (state.agg(F.max("miss")).first()[0] or 0.0) == 0.0:
            break
    else:
        raise RuntimeError(f"source rates did not settle in {rounds} rounds")
    return joined(state).select("source", "class", "n", "tokens", *cols[1:], _rate(most).alias("rate"))


def _round_source(rows: pd.DataFrame, most: float) -> pd.DataFrame:
    """Whole copies for each size class of one source, largest sizes first, carrying the missing words along.

    At most some ten thousand classes per source (``size_class``), never its documents.
    """
    rows = rows.sort_values("class", ascending=False)
    due, given, copies = 0.0, 0.0, []
    for n, tokens, rate in zip(rows["n"], rows["tokens"], rows["rate"], strict=True):
        each, most_copies = tokens / n, int(most * n)
        due += rate * tokens
        k = round(rate * n) if each == 0 else round((due - given) / each)
        k = max(0, min(most_copies, k))
        given += k * each
        copies.append(k)
    rows["copies"] = copies
    return rows[["class", "n", "copies", "source", "source_size", "target"]]


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row.

    ``copies`` is a whole number up to ``most`` and ``taken`` is ``copies * size``. Null
    texts have size 0; a null source is a source, last in order; sources are of any type that
    can be sorted. Extra copies go by the hash of the whole row, so they don't depend on the
    order of rows, and only equal rows tie: of these as many as are due take one more.
    """
    rows, plain = _sized(docs, text_col, source_col)
    sized = materialise(rows.select(F.col(plain[docs.columns.index(id_col)]).alias("doc_id"), "source", "size", "class", "h", F.monotonically_increasing_id().alias("at")), "mix-sizes")
    dealt = _with_cuts(sized, extra_cuts(sized, mix_plan(sized, weights, share, most)))
    # equal rows at the cut are numbered by where they were written, within the parts of the table
    tied = dealt.where("h = tie").withColumn("part", F.shiftrightunsigned("at", 33))
    keys = ["source", "class"]
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tied.groupBy(*keys, "part").agg(F.count("*").alias("n")).select(*[F.col(k).alias(f"of_{k}") for k in (*keys, "part")], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    met = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class")) & (F.col("part") == F.col("of_part"))
    place = F.col("base") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("at"))
    tied = tied.join(F.broadcast(bases), met).withColumn("copies", F.col("each") + F.when(place <= F.col("tied"), 1).otherwise(0))
    names = ["doc_id", "size", "source", "source_size", "target", "copies"]
    every = dealt.where("tie IS NULL OR h <> tie").select(*names).unionByName(tied.select(*names))
    return every.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def _sized(docs: DataFrame, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ... and source, size, class and ``h``, the hash of the whole row by which rows are ordered."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*plain)
    text, source = (F.col(plain[docs.columns.index(c)]) for c in (text_col, source_col))
    h = row_hash(rows)
    rows = rows.withColumn("source", source).withColumn("size", n_words(text)).withColumn("h", h)
    return rows.withColumn("class", size_class(F.col("size"))), plain


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, class, n, copies, source_size, target: how many copies each size class of a source gets. ``sized``: source, size, class."""
    classes = materialise(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "mix-classes")
    rated = balance(classes, source_targets(classes, weights, share, most), most)
    schema = f"class long, n long, copies long, source {sized.schema['source'].dataType.simpleString()}, source_size long, target double"
    return materialise(rated.groupBy("source").applyInPandas(lambda rows: _round_source(rows, most), schema), "mix-plan")


def extra_cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, class, source_size, target, each, cut, tie, tied: a row takes ``each`` copies, and one more if its h is ``cut`` or less.

    ``tied`` more go to rows whose h is ``tie``: equal rows of which only some are due. A
    class's hashes are counted first, so equal rows are one row from there on. Of n rows, some
    sqrt(n) ranges of hashes are then added up, and only the range that holds the cut is sorted.
    """
    keys = ["source", "class"]
    share = plan.select(*[F.col(k).alias(f"of_{k}") for k in keys], "n", "source_size", "target", F.floor(F.col("copies") / F.col("n")).cast("long").alias("each"), (F.col("copies") % F.col("n")).alias("extra"))
    met = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class"))
    cells = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.col("n").cast("double"))))
    # rises with h, whatever the rounding
    cell = F.least(cells - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * cells)).cast("long")
    hashes = sized.groupBy(*keys, "h").agg(F.count("*").alias("held"))
    open_ = share.where("extra > 0")
    hashes = hashes.join(_side(open_), met).select(*keys, "h", "held", "extra", cell.alias("cell"))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashes.groupBy(*keys, "cell", "extra").agg(F.sum("held").alias("held"), F.max("h").alias("last"))
    counts = counts.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("low", F.max("last").over(before))
    cut_cells = counts.where("base < extra AND base + held >= extra").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("cell").alias("of_cell"), "base", "low")
    near = hashes.join(_side(cut_cells), met & (F.col("cell") == F.col("of_cell")))
    upto = F.col("base") + F.sum("held").over(Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    fits = F.col("upto") <= F.col("extra")
    cuts = near.groupBy(*keys, "extra").agg(
        F.coalesce(F.max(F.when(fits, F.col("h"))), F.max("low")).alias("cut"),
        F.min(F.when(~fits, F.col("h"))).alias("next"),
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.max("base")).alias("reached"),
    )
    due = F.col("extra") - F.col("reached")
    cuts = cuts.select(*[F.col(k).alias(k) for k in keys], "cut", F.when(due > 0, F.col("next")).alias("tie"), due.alias("tied"))
    out = share.join(cuts, met, "left").select(*[F.col(f"of_{k}").alias(k) for k in keys], "source_size", "target", "each", "cut", "tie", "tied")
    return materialise(out, "mix-cuts")


def _side(classes: DataFrame) -> DataFrame:
    """A table of size classes, broadcast up to ``BROADCAST_CLASSES`` rows; beyond, Spark joins by source and class."""
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (source, class, h and more) with copies, source_size, target and the ties of their class."""
    side = cuts.withColumnsRenamed({"source": "of_source", "class": "of_class"})
    met = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class"))
    return rows.join(_side(side), met).withColumn("copies", F.col("each") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)).drop("of_source", "of_class")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it (columns as in ``docs``).

    Every row is rated and copied by itself, so null and repeated ids are rows like
    any other; null texts and sources as in ``mix``. Rows stay where they are: a row knows
    its copies from its class's cut. Where equal rows tie, one of them is moved and repeated for all.
    """
    rows, plain = _sized(docs, text_col, source_col)
    sized = materialise(rows.select("source", "size", "class", "h"), "mix-sizes")
    cuts = extra_cuts(sized, mix_plan(sized, weights, share, most))
    dealt = _with_cuts(rows, cuts)
    taken = dealt.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies AS int))"))).select(*plain)
    if not cuts.where("tie IS NOT NULL").isEmpty():
        tied = dealt.where("h = tie").dropDuplicates(["source", "class", "h"])
        # the repeats of a row are dealt in lots, so no task writes all of them
        lots = F.expr(f"sequence(0, cast((tied - 1) div {LOT_ROWS} AS int))")
        dealt_lots = tied.withColumn("lot", F.explode(lots)).repartition("h", "lot")
        size = F.least(F.lit(LOT_ROWS), F.col("tied") - F.col("lot") * LOT_ROWS).cast("int")
        taken = taken.unionByName(dealt_lots.withColumn("copy", F.explode(F.array_repeat(F.lit(0), size))).select(*plain))
    return taken.toDF(*docs.columns)
