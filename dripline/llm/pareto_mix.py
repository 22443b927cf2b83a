"""Mixing sources to target weights by Pareto order sampling.

A source that is to give ``t`` of its ``s`` words gives ``floor(t / s)`` whole copies of every document for certain.
For the rest each document has the inclusion probability ``p = t / s - floor(t / s)``; it is ranked by the odds of a
random number over the odds of ``p``, and the documents of lowest rank are taken until the words of the rest are
reached. The random number is a hash of the document, so reruns and retried tasks agree.

The cut in each source is found by narrowing: words are counted in bins of the rank, the bin that holds the cut is
binned again, and only when few rows are left are they ordered. No source, however large, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import WORD, running_total, small_side, table, written

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 42
#: Bins of one narrowing step, rows of one source that may be ordered, and steps after which ranks are equal.
BINS, FEW_ROWS, STEPS = 4096, 10_000, 4


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD + "+")), F.lit(0)).cast("long")


def _key(source_col: str) -> Column:
    """Source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number between 0 and 1 that depends on the document only."""
    h = F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")), F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source_key, source_size, target): all words shared by weight, none above ``max_copies`` times its source.

    ``sizes`` has source, source_key and source_size; sources take the weights in turn, by code point, null last.
    A share is ``weight * level``; what capped sources leave raises the level until no share is above its cap.
    """
    placed = running_total(sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], "_one", "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    held = written(placed.select("source_key", "source_size", weight.alias("weight")), "shares")
    cap = F.col("source_size") * float(max_copies)
    total, level, before = held.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        got = held.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.coalesce(F.sum(above.cast("int")), F.lit(0)).alias("n"),
        ).first()
        if got.n == before or not got.free:
            break
        before, level = got.n, (total - got.capped) / got.free
    return held.select("source_key", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _rank(u: str = "u", p: str = "p") -> Column:
    """Pareto rank q = odds(u) / odds(p), as q / (1 + q) so that it lies between 0 and 1; no odds: never taken."""
    q = F.col(u) / (1 - F.col(u)) * (1 - F.col(p)) / F.col(p)
    return F.when(F.col(p) > 0, q / (1 + q)).otherwise(1.0)


def _cut(ranked: DataFrame, need: DataFrame) -> DataFrame:
    """Per source the ranks that fill ``need`` words without going over: those under ``low`` and those up to ``upto``.

    ``missing`` is what they leave open; it is smaller than the document that comes next, if there is one.
    """
    state = small_side(need.select("source_key", "need", F.lit(0).cast("long").alias("bin")))
    scale = 1.0
    for _ in range(STEPS):
        inside = ranked.join(state, "source_key").filter(F.floor(F.col("v") * scale) == F.col("bin"))
        scale *= BINS
        counts = inside.groupBy("source_key", "need", F.floor(F.col("v") * scale).alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        counts = counts.withColumn("upto", F.sum("words").over(Window.partitionBy("source_key").orderBy("bin")))
        # The first bin that goes over the need; without one the last bin, which is then taken whole.
        found = F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "n")
        hit = counts.groupBy("source_key").agg(
            F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), found)), F.max(found)).alias("x")
        )
        state = small_side(hit.select("source_key", "x.need", "x.bin", "x.n"))
        if (state.agg(F.max("n")).first()[0] or 0) <= FEW_ROWS:
            break
        state = state.drop("n")
    inside = ranked.join(state, "source_key").filter(F.floor(F.col("v") * scale) == F.col("bin"))
    ties = inside.groupBy("source_key", "need", "v").agg(F.sum("size").alias("words"))
    ties = ties.withColumn("sum", F.sum("words").over(Window.partitionBy("source_key").orderBy("v")))
    fits = F.col("sum") <= F.col("need")
    ends = ties.groupBy("source_key").agg(
        F.max(F.when(fits, F.col("v"))).alias("upto"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0)).alias("got")
    )
    cut = state.join(ends, "source_key").select(
        "source_key", (F.col("bin") / scale).alias("low"), "upto", (F.col("need") - F.col("got")).alias("missing")
    )
    return small_side(cut)


def _under(cut: str) -> Column:
    low, upto = F.col(f"{cut}.low"), F.col(f"{cut}.upto")
    return F.coalesce((F.col("v") < low) | F.coalesce(F.col("v") <= upto, F.lit(False)), F.lit(False))


def _as(cut: DataFrame, name: str) -> DataFrame:
    return cut.select("source_key", F.struct("low", "upto", "missing").alias(name))


def _cuts(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: the first cut, a second one among later documents that fit into what the first leaves open, and
    the one further rank whose words come nearest to what is still missing, if it helps."""
    first = _as(_cut(ranked, plan.withColumnRenamed("rest", "need")), "first")
    fitting = ranked.join(small_side(first), "source_key").filter(~_under("first") & (F.col("size") <= F.col("first.missing")))
    second = _as(_cut(fitting, first.select("source_key", F.col("first.missing").alias("need"))), "second")
    cuts = small_side(first.join(second, "source_key", "left"))
    open_words = F.coalesce("second.missing", "first.missing")
    others = ranked.join(cuts, "source_key").filter(~_taken() & (F.col("size") > 0))
    # Documents of one rank are taken together, so they are weighed together.
    ties = others.groupBy("source_key", "v", open_words.alias("open")).agg(F.sum("size").alias("words"))
    near = ties.groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("open") - F.col("words")).alias("off"), "v")).alias("x"))
    better = F.col("x.off") < open_words
    out = cuts.join(near, "source_key", "left")
    return small_side(out.select("source_key", "first", "second", F.when(better, F.col("x.v")).alias("extra")))


def _taken() -> Column:
    return _under("first") | F.coalesce((F.col("size") <= F.col("first.missing")) & _under("second"), F.lit(False))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(row, size, source_size, target, copies) of every row: how often the mix takes it.

    Null texts have size 0. Null is a source of its own, the last. Rows equal in id and text are drawn together.
    Sources without words have target 0 and are not taken. Tables without words or rows give no copies. A text of any
    length counts whole; a source of few documents comes as near to its target as whole documents allow.
    """
    spread = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _key(source_col).alias("source_key"),
        word_count(text_col).alias("size"),
        _draw(id_col, text_col, seed).alias("u"),
    )
    sized = written(spread.select("source_key", F.col(f"row.`{source_col}`").alias("source"), "size", "u"), "sizes")
    per_source = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = goal.withColumn("whole", F.least(F.floor(ratio), F.lit(max_copies)).cast("int")).withColumn(
        "p", F.when(F.col("whole") < max_copies, ratio - F.col("whole")).otherwise(0.0)
    )
    plan = small_side(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    ranked = sized.join(plan.filter("p > 0").select("source_key", "p"), "source_key")
    ranked = written(ranked.select("source_key", "size", _rank().alias("v")), "ranks")
    cuts = _cuts(ranked, plan.filter("p > 0").select("source_key", "rest"))
    decided = small_side(plan.join(cuts, "source_key", "left"))
    out = spread.join(decided, "source_key").withColumn("v", _rank())
    more = (_taken() | F.coalesce(F.col("v") == F.col("extra"), F.lit(False))) & (F.col("p") > 0)
    return out.select("row", "size", "source_size", "target", (F.col("whole") + more.cast("int")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every taken document as often as it is taken."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@query("op2_pareto_mix")
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
