"""Joins, merges and sweeps of half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a contig that one task sweeps.
TILE = 1 << 20
#: Items of a list where lists of a bin meet, so a task holds LISTED * LISTED pairs at once.
LISTED = 128


def _binned(df: DataFrame, span: tuple[str, str], bin_size: int, name: str) -> DataFrame:
    """A row for each bin that an interval touches; none for an empty one."""
    first, last = F.floor(F.col(span[0]) / bin_size).cast("bigint"), F.floor((F.col(span[1]) - 1) / bin_size).cast("bigint")
    return df.filter(F.col(span[1]) > F.col(span[0])).withColumn(name, F.explode(F.sequence(first, last)))


def _meet(a: DataFrame, b: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, how: str) -> DataFrame:
    """Pairs of binned rows, each once; b's key is _rkey."""
    (ls, le), (rs, re_) = left_span, right_span
    meets = (F.col(key) == F.col("_rkey")) & (F.col("_bin") == F.col("_rbin")) & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    if how == "left_semi":
        return a.join(b, meets, "left_semi").drop("_bin").distinct()
    once = F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_size)
    return a.join(b, meets & once, how).drop("_bin", "_rbin", "_rkey")


def range_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of one key whose intervals overlap.

    Both sides go to all bins that their intervals touch and meet by (key, bin); a pair is kept in the first bin that
    both touch, so it appears once. The work per bin is what overlaps there, not all of a contig. `left` and `right`
    have no column in common but `key`. how: inner, left_semi.
    """
    a = _binned(left, left_span, bin_size, "_bin")
    b = _binned(right, right_span, bin_size, "_rbin").withColumnRenamed(key, "_rkey")
    return _meet(a, b, key, left_span, right_span, bin_size, how)


def _listed(df: DataFrame, by: list[str], items: list[str], name: str) -> DataFrame:
    """by, name: the items of equal `by`, in lists of LISTED at most. No shuffle if df is dealt out by some of `by`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(by[0]))
    parts = df.withColumn("_part", F.floor((nth - 1) / LISTED))
    return parts.groupBy(*by, "_part").agg(F.collect_list(F.struct(*items)).alias(name)).drop("_part")


def count_pairs(left: DataFrame, right: DataFrame, key: str, left_id: list[str], right_id: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int) -> DataFrame:
    """left_id, right_id, n: the pairs of range_join() counted by their ids. left_id gives the interval within a key; left has no other columns.

    Rows of either side that are equal are counted before they meet, within the bins that the join needs anyway. So a
    pair of ids comes out of the join once and is moved no more: what is shuffled follows the inputs, not the pairs.
    Only ids of the right side that have several intervals are summed after it.

    Within a bin, lists meet: those of the first of left_id that agree in all else, and those of the right side's
    intervals. An interval is compared once with a list, not with each of its ids, and pairs are unfolded by plain loops.
    """
    (ls, le), (rs, re_) = left_span, right_span
    name, alike = left_id[0], [*left_id[1:], *[c for c in left_span if c not in left_id]]
    counted = _binned(left, left_span, bin_size, "_bin").repartition(key, "_bin").groupBy(key, "_bin", name, *alike).agg(F.count(F.lit(1)).alias("_ln"))
    a = _listed(counted, [key, "_bin", *alike, "_ln"], [name], "_names").withColumn("_names", F.col(f"_names.{name}"))
    features = right.groupBy(right_id, key, *right_span).agg(F.count(F.lit(1)).alias("_rn"))
    features = features.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy(right_id)) > 1).withColumnRenamed(key, "_rkey")

    def pairs(part: DataFrame) -> DataFrame:
        binned = _binned(part, right_span, bin_size, "_rbin").repartition("_rkey", "_rbin")
        b = _listed(binned, ["_rkey", "_rbin"], [right_id, rs, re_, "_rn"], "_features")
        # a plan step between the join and the unfolding: what a compiled step holds at once is then two lists' pairs, not a bin's
        lists = a.join(b, (F.col(key) == F.col("_rkey")) & (F.col("_bin") == F.col("_rbin"))).coalesce(1 << 20)
        near = lists.select(*alike, "_names", "_ln", (F.col("_bin") * bin_size).alias("_from"), F.explode("_features").alias("_f"))
        # both touch the bin: it is their first one if either begins in it
        met = near.filter((F.col(ls) < F.col(f"_f.{re_}")) & (F.col(f"_f.{rs}") < F.col(le)) & (F.greatest(F.col(ls), F.col(f"_f.{rs}")) >= F.col("_from")))
        named = met.select(*alike, F.col(f"_f.{right_id}").alias(right_id), (F.col("_ln") * F.col("_f._rn")).alias("n"), F.explode("_names").alias(name))
        return named.select(*left_id, right_id, "n")

    # an id of one interval has one key, where equal left ids are one row
    summed = pairs(features.filter("_several")).groupBy(*left_id, right_id).agg(F.sum("n").alias("n"))
    return pairs(features.filter("not _several")).unionByName(summed)


def merge_intervals(df: DataFrame, key: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Union of the intervals of each key; those that touch are one."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = df.filter(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1)))
    return fresh.withColumn("_island", F.sum("_new").over(upto)).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def depth_segments(blocks: DataFrame, key: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end, depth: maximal-by-event stretches with a depth of 1 or more.

    Events are summed per position, and swept within tiles of a contig: a tile begins at the depth that the events of the
    tiles before it leave, and its last stretch ends where the next tile's first event lies. So a task holds a tile, and
    only the tiles' sums are swept over a whole contig.
    """
    event = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"))))
    events = blocks.select(key, event.alias("e")).groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    tiled = events.withColumn("_tile", F.floor(F.col("at") / TILE))
    along = Window.partitionBy(key).orderBy("_tile")  # a row for each tile
    sums = tiled.groupBy(key, "_tile").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))
    tiles = sums.select(key, "_tile", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"), F.lead("_first").over(along).alias("_next"))
    w = Window.partitionBy(key, "_tile").orderBy("at")
    swept = tiled.join(tiles, [key, "_tile"]).select(key, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), "_next").alias("end"), (F.col("_before") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"))
    return swept.filter("end is not null and depth > 0")


def windows(contigs: DataFrame, size: int, key: str = "contig", length: str = "length") -> DataFrame:
    """key, start, end: tiles of each contig, the last one short."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(length) - 1, F.lit(0)).cast("bigint"), F.lit(size).cast("bigint")))
    return contigs.filter(F.col(length) > 0).select(key, F.col(length).alias("_l"), starts.alias("start")).select(key, "start", F.least(F.col("start") + size, F.col("_l")).alias("end"))


def histogram_quantile(hist: DataFrame, q: float, value: str, count: str = "count", by: list[str] | None = None) -> DataFrame:
    """Nearest-rank quantile of a histogram: the first value whose running count reaches round((n - 1) * q) + 1."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = hist.withColumn("_cum", F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum(count).over(w))
    reached = ranked.filter(F.col("_cum") >= F.floor((F.col("_n") - 1) * q + 0.5) + 1)
    return reached.groupBy(*by).agg(F.min(value).alias("quantile"))
