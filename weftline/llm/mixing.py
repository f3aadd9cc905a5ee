"""Mix sources to target weights: how often each document is taken, found without a sort.

Every source has a weight; the sources share a budget of words by weight, none more than
``most`` times its own size, and what a capped source cannot use is shared again by weight.
A source whose target is ``c`` times its size and a rest takes all its documents ``c`` times,
and those below a threshold of a hash once more. The hash covers identity and text, so
reruns agree, and the documents of a smaller budget are always among those of a larger one.

The thresholds come from histograms: words are summed per source and bucket of the hash's
first bits; running sums over the buckets of a source (1,024) show in which the
rest ends; only the rows of that bucket are summed again by the next bits, until it
holds one row. That row is taken if this brings the source nearer to its target, so a source
misses its target by at most half of one document's words. Rows that repeat each other
entirely share a hash; a number given to each written row goes on where the hash ends, and
which of them is taken makes no difference to the result.

All steps are DataFrame operations. The texts are read once; everything after works on a
written table of identities, sizes and hashes. A hot source is summed by bucket before it
is shuffled. Thresholds, one row per source, are broadcast below a checked size and joined
over salted keys beyond it.

NULL texts and texts without a word have size 0 and are taken 0 words. NULL is a source of its
own, after all others. Repeated rows count each for itself, also under one ``doc_id`` or NULL. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: What each histogram is over: ten bits of the hash (60 bits) at a time, then of the row number (63 bits). The shift of the bits.
LEVELS = [*(("h", shift) for shift in range(50, -1, -10)), *(("tie", shift) for shift in (53, 43, 33, 23, 13, 3, 0))]
RANGES = 64
BROADCAST_BYTES = 16 << 20
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of a document's id and text."""
    identity = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """The written table of all documents: ``doc_id``, ``source``, ``size``, ``h``, ``tie``."""
    rows = docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        place(F.col("doc_id"), F.col("text")).alias("h"),
        F.monotonically_increasing_id().alias("tie"),
    )
    return cut_lineage(rows, "sizes")


def weighted(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``source``, ``source_size``, ``weight``: weights go round the sources in the order of code points, NULL last."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNull(), F.col("source"))
    dealt = cut_lineage(sources.repartitionByRange(RANGES, *order).withColumn("part", F.spark_partition_id()), "sources")
    # At most RANGES rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    round_ = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(round_, (at % len(weights)).cast("int") + 1)
    return cut_lineage(dealt.join(F.broadcast(bases), "part").select("source", "source_size", weight.alias("weight")), "weights")


def share(sources: DataFrame, total: int, most: int) -> Column:
    """The target of each source. Each round frees the excess of more sources; Newton's steps on a concave line, so few."""
    cap = F.col("source_size") * most
    level, known = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        r = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if r["n"] == known:
            return F.when(over, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
        if not r["weight"]:
            return cap.cast("double")
        level, known = (total - r["capped"]) / r["weight"], r["n"]


def goals(sources: DataFrame, budgets: Sequence[float], most: int) -> DataFrame:
    """Per source and budget ``k``: ``target``, ``whole`` (times all documents are taken), ``rest`` (words still to take)."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = [share(sources, total if b == 1 else round(b * total), most) for b in budgets]
    listed = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("target")) for k, t in enumerate(targets)])
    out = sources.select("source", "source_size", F.inline(listed)).withColumn("words", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    out = out.withColumn("whole", whole).withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
    return cut_lineage(out.drop("words"), "goals")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source and ``k`` of ``wanted`` with words to take: rows before (``h_limit``, ``tie_limit``) are taken once more."""
    held = rows.where("size > 0").select("source", "size", "h", "tie")
    zero = F.lit(0).cast("bigint")
    state = wanted.where("rest > 0").select("source", "k", "rest", zero.alias("h_low"), zero.alias("tie_low"))
    found, previous = None, None
    for name, shift in LEVELS:
        if previous is not None:
            # Only rows of the buckets in which a rest ends; the buckets of two budgets may be the same.
            own = [_floor(F.col("h"), previous["h"]).alias("h_low"), _floor(F.col("tie"), previous["tie"]).alias("tie_low")]
            open_cells = state.select("source", "h_low", "tie_low").distinct()
            held = cut_lineage(attach(held.select("source", "size", "h", "tie", *own), open_cells, ["source", "h_low", "tie_low"]), "bucket")
        else:
            held = held.select("*", zero.alias("h_low"), zero.alias("tie_low"))
            previous = {"h": 63, "tie": 63}
        previous[name] = shift
        cell = _floor(F.col(name), shift).alias("cell")
        cells = held.groupBy("source", "h_low", "tie_low", cell).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        cells = attach(cells, state, ["source", "h_low", "tie_low"], spread="cell")
        upto = Window.partitionBy("source", "k").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        ends = cells.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        ends = ends.where("before <= rest and rest < before + words")
        ends = ends.withColumn("rest", F.col("rest") - F.col("before")).withColumn(f"{name}_low", F.col("cell"))
        ends = cut_lineage(ends.select("source", "k", "rest", "words", "n", "h_low", "tie_low"), "ends")
        taken = F.when(2 * F.col("rest") > F.col("words"), F.lit(1 << shift)).otherwise(zero)
        limit = {"h": F.col("h_low"), "tie": F.col("tie_low")}
        limit[name] = limit[name] + taken
        some = ends.where("n = 1").select("source", "k", limit["h"].alias("h_limit"), limit["tie"].alias("tie_limit"))
        found = some if found is None else found.unionByName(some)
        state = ends.where("n > 1").drop("words", "n")
        if state.isEmpty():
            break
    return found


def _floor(value: Column, shift: int) -> Column:
    return F.lit(0).cast("bigint") if shift >= 63 else F.shiftleft(F.shiftright(value, shift), shift)


def attach(rows: DataFrame, small: DataFrame, on: Sequence[str], spread: str = "tie") -> DataFrame:
    """Inner join to a table of few rows per source, NULL equal to NULL; no task meets all rows of a hot source."""
    small = small.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in small.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    size = small.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 16 * len(small.columns))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(small), same)
    else:
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, [*same, F.col("salt") == F.col("_salt")]).drop("salt", "_salt")
    return joined.drop(*[f"_{c}" for c in on])


def mix(docs: DataFrame, budgets: Sequence[float] = (1.0,), weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, and the array ``mixes``.

    ``budgets`` are shares of all words. ``mixes`` has, in their order, ``target`` (of the row's
    source) and ``taken`` (words of the row, repeats counted, 0 to ``most`` times its size).
    """
    rows = sized(docs)
    wanted = goals(weighted(rows, weights), budgets, most)
    limits = thresholds(rows, wanted).select(F.col("source").alias("_source"), F.col("k").alias("_k"), "h_limit", "tie_limit")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("k") == F.col("_k"))
    zero = F.lit(0).cast("bigint")
    full = wanted.join(limits, same, "left").select(
        "source",
        "source_size",
        F.struct("k", "target", "whole", F.coalesce("h_limit", zero).alias("h_limit"), F.coalesce("tie_limit", zero).alias("tie_limit")).alias("goal"),
    )
    per_source = full.groupBy("source", "source_size").agg(F.sort_array(F.collect_list("goal")).alias("goals"))
    out = attach(rows, cut_lineage(per_source, "goals"), ["source"])

    def made(goal: Column) -> Column:
        below = (F.col("h") < goal["h_limit"]) | ((F.col("h") == goal["h_limit"]) & (F.col("tie") < goal["tie_limit"]))
        times = goal["whole"] + below.cast("bigint")
        return F.struct(goal["target"].alias("target"), (F.col("size") * times).alias("taken"))

    return out.select("doc_id", "source", "size", "source_size", F.transform("goals", made).alias("mixes"))
