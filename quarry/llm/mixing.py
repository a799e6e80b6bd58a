"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Every row falls into one of ``BLOCKS`` blocks of its source by a seeded hash of the whole row.  A source whose target is
k.f times its size is taken k times whole; the fraction is filled with blocks in hash order up to the boundary block, in
which two finer levels of the same hash find the last row.  Only boundary blocks are looked into, so no window ever
covers a whole source.  Rows that agree in every column share a hash; where the boundary falls among them, so many of
them are taken as fit, which one does not matter.  (pass, block) pairs are the units that are dealt to output shards: a
tree halves the shards level by level, and each node draws, without replacement from its own units, how many of each
source go left.  That draw is multivariate hypergeometric, and the quotas are exact.  A source's units, permuted, then
fill its quotas in turn.  A node's draw counts its slots by the leading bits of their keys and ranks those of one cell
only, so that very many sources are not gathered in one task.  Tables of units have at most 768 rows for each source,
whatever the size of the input; the targets come from a sort of one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

BLOCKS = 256
FINE = 4096
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hashable(name: str, kind: str) -> Column:
    """A column as xxhash64 takes it: maps and variants as text."""
    c = F.col(f"`{name}`")
    return c.cast("string") if "map<" in kind or "variant" in kind else c


def _sized(docs: DataFrame, seed: int, keep: bool = False) -> DataFrame:
    """_src, doc_id, _size and the place in the source's permutation: _h, its leading bits _l1 and the next ones _l2.
    keep: the whole row too, as one struct, so that no name of the user's can clash."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    # a null source is keyed by an empty array, others by an array of the name
    key = F.when(F.col("source").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("source").cast("string")))
    h = F.xxhash64(F.lit(seed), *[_hashable(c, k) for c, k in docs.dtypes])
    d = docs.select(*row, key.alias("_src"), F.col("doc_id"), n_words().alias("_size"), h.alias("_h"))
    return d.withColumn("_l1", F.shiftrightunsigned("_h", 52).cast("int")).withColumn("_l2", (F.shiftrightunsigned("_h", 40) % FINE).cast("int"))


def _targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3 in turn by code point, null last; one row for each source."""
    s = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", ((F.row_number().over(order) - 1) % MOST + 1).cast("double")).withColumn("most", F.col("source_size") * float(MOST))
    # sources reach their limit in the order of limit / weight; the level is what the rest share by weight
    by_limit = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (whole - before) / rest)
    # of sources that tie, the first has the level of all; those after it count it as if it had reached its limit
    level = -F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct(F.col("most") / F.col("w"), (-F.col("level")).alias("less")))).over(W.partitionBy())["less"]
    return s.select("source", "source_size", F.least("most", F.col("w") * F.coalesce(level, F.col("level"))).alias("target"))


def _boundary(cells: DataFrame, rest: DataFrame, on: list[str], level: str) -> DataFrame:
    """The cell of each source in which the remaining words run out, and what then remains.

    ``cells`` (with _src, ``on``, ``level``, _size) are summed before anything is joined, so that a source of very many
    rows comes down to at most FINE cells in the tasks that read it.
    """
    order = W.partitionBy("_src").orderBy(level)
    summed = cells.groupBy("_src", *on, level).agg(F.sum("_size").alias("n")).join(rest, ["_src", *on])
    found = summed.withColumn("before", F.sum("n").over(order) - F.col("n")).where("before <= _rest AND before + n > _rest")
    return found.select("_src", (F.col("_rest") - F.col("before")).alias("_rest"), *on, level)


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, leaf, split) for the rows of ``_sized``: sources has the targets and boundary cells; leaf the hashes
    (_src, _h) in the boundary cell of which every row is taken; split those of which ``take`` rows of ``m`` are."""
    goal = _targets(sizes.select(F.try_element_at("_src", F.lit(1)).alias("source"), "_size"))
    key = F.when(F.col("source").isNull(), F.array().cast("array<string>")).otherwise(F.array("source"))
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = shared.written(goal.select(key.alias("_src"), "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("_rest")), "mix-goals")
    one = shared.written(_boundary(sizes, goal.select("_src", "_rest"), [], "_l1"), "mix-coarse")
    two = shared.written(_boundary(sizes.join(one.select("_src", "_l1"), ["_src", "_l1"], "left_semi"), one, ["_l1"], "_l2"), "mix-boundary")
    rows = sizes.where("_size > 0").join(two, ["_src", "_l1", "_l2"]).groupBy("_src", "_rest", "_h").agg(F.max("_size").alias("_size"), F.count("*").alias("m"))
    n = F.col("m") * F.col("_size")
    run = F.sum(n).over(W.partitionBy("_src").orderBy("_h"))
    # of the rows that share a hash so many are taken as fit; those after the first that does not fit wholly find no room
    fit = F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.col("_rest") - (run - n)) / F.col("_size")))).cast("long")
    last = shared.written(rows.withColumn("take", fit).where("take > 0").select("_src", "_h", "_size", "take", "m"), "mix-last")
    sums = last.groupBy("_src").agg(F.sum(F.col("take") * F.col("_size")).alias("run"))
    # what is still missing is closed by the one row whose size comes nearest, if that is nearer than none
    gap = two.join(sums, "_src", "left").select("_src", (F.col("_rest") - F.coalesce("run", F.lit(0))).alias("gap"), F.col("_l1").alias("b1"), F.col("_l2").alias("b2"))
    gap = shared.written(gap, "mix-gaps")  # a row for each source: its size is known to the planner
    left = sizes.where("_size > 0").join(gap, "_src").where("_l1 > b1 OR (_l1 = b1 AND _l2 >= b2)").where("_size < 2 * gap")
    left = left.join(last.where("take = m"), ["_src", "_h"], "left_anti")
    close = left.groupBy("_src").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("_size")).alias("off"), "_h")).alias("c")).select("_src", F.col("c._h").alias("_h"), F.lit(1).cast("long").alias("take"))
    ends = shared.written(last.where("take < m").select("_src", "_h", "take").unionAll(close).groupBy("_src", "_h").agg(F.sum("take").alias("take")), "mix-ends")
    counted = shared.written(sizes.join(ends, ["_src", "_h"]).groupBy("_src", "_h", "take").agg(F.count("*").alias("m")), "mix-counted")
    leaf = shared.written(last.where("take = m").select("_src", "_h").unionAll(counted.where("take = m").select("_src", "_h")), "mix-leaf")
    split = shared.written(counted.where("take < m"), "mix-split")
    sources = shared.written(goal.drop("_rest").join(two.select("_src", F.col("_l1").alias("b1"), F.col("_l2").alias("b2")), "_src", "left"), "mix-sources")
    shared.drop(goal, one, two, last, gap, ends, counted)
    return sources, leaf, split


def _copies(rows: DataFrame, sources: DataFrame, leaf: DataFrame, split: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and _lone (null, or a number that tells apart rows that share a hash) to the rows
    of ``_sized``."""
    r = rows.join(sources, "_src", "left")
    taken = leaf.select(F.col("_src").alias("_s"), F.col("_h").alias("_g"), F.lit(1).alias("_in"))
    whole = (F.col("_l1") < F.col("b1")) | ((F.col("_l1") == F.col("b1")) & (F.col("_l2") < F.col("b2")))
    some = [] if split.isEmpty() else [r.join(split, ["_src", "_h"])]
    if some:
        # rows that agree in every column: counted, then dealt out again in pieces
        r = r.join(split.select("_src", "_h"), ["_src", "_h"], "left_anti")
        same = [c for c in r.columns if c not in ("_src", "_h")]
        one = some[0].groupBy("_src", "_h", "take").agg(*[F.first(c).alias(c) for c in same], F.count("*").alias("m"))
        piece = one.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(1000).cast("long")))).repartition("_src", "_h", "_lo")
        each = piece.withColumn("_lone", F.explode(F.sequence("_lo", F.least(F.col("_lo") + 999, F.col("m") - 1))))
        some = [each.withColumn("_extra", F.when(F.col("_lone") < F.col("take"), 1).otherwise(0)).select("_src", "_h", *same, "_extra", "_lone")]
    r = r.join(taken, (r._src == taken._s) & (r._h == taken._g), "left").drop("_s", "_g")
    r = r.withColumn("_extra", F.when(whole | F.col("_in").isNotNull(), 1).otherwise(0)).drop("_in").withColumn("_lone", F.lit(None).cast("long"))
    for s in some:
        r = r.unionByName(s)
    return r.withColumn("copies", F.when(F.col("_size") > 0, F.least(F.lit(MOST), F.col("passes") + F.col("_extra"))).otherwise(0).cast("int")).drop("_extra", "passes", "b1", "b2")


def _drawn(node: DataFrame, key: Column) -> DataFrame:
    """(_src, node, n) of the children: of a node's slots (n of each source) a half, drawn without replacement, goes left.

    A node's slots are counted by the leading bits of their keys; those of the cell in which the half ends are ranked.
    """
    slot = node.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("k", key).withColumn("cell", F.shiftrightunsigned("k", 52).cast("int")).drop("n")
    cells = slot.groupBy("node", "cell").agg(F.count("*").alias("n"))
    run, half = F.sum("n").over(W.partitionBy("node").orderBy("cell")), F.floor(F.sum("n").over(W.partitionBy("node")) / 2)
    edge = cells.withColumn("run", run).withColumn("half", half).where("run > half AND run - n <= half").select("node", F.col("cell").alias("at"), (F.col("half") - F.col("run") + F.col("n")).alias("room"))
    placed = slot.join(edge, "node")
    sure = placed.where("cell <> at").select("_src", "node", (F.col("cell") > F.col("at")).cast("long").alias("right"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("k", "_src", "i"))
    last = placed.where("cell = at").withColumn("rank", rank).select("_src", "node", (F.col("rank") > F.col("room")).cast("long").alias("right"))
    return sure.unionAll(last).groupBy("_src", (F.col("node") * 2 + F.col("right")).alias("node")).agg(F.count("*").alias("n"))


def units(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_src, pass, block, shard): the splitting tree's quotas, filled with each source's permuted units."""
    depth = max(0, (shards - 1).bit_length())
    per = (F.col("passes") * BLOCKS + F.when(F.col("b1").isNotNull(), F.floor(F.col("b1") / (FINE // BLOCKS)) + 1).otherwise(0)).cast("long")
    unit = sources.select("_src", F.explode(F.sequence(F.lit(0).cast("long"), per)).alias("u"), per.alias("q")).where("u < q").drop("q")
    node = shared.written(unit.groupBy("_src").agg(F.count("*").alias("n")).withColumn("node", F.lit(0).cast("long")), "mix-node")
    for level in range(depth):
        was, node = node, shared.written(_drawn(node, F.xxhash64(F.lit(seed + 101 * (level + 1)), "node", "_src", "i")), "mix-node")
        shared.drop(was)
    quota = node.withColumn("hi", F.sum("n").over(W.partitionBy("_src").orderBy("node"))).select("_src", F.col("node").cast("int").alias("shard"), (F.col("hi") - F.col("n")).alias("lo"), "hi")
    place = unit.withColumn("r", F.row_number().over(W.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed), "_src", "u"), "u")))
    out = place.join(quota, "_src").where("r > lo AND r <= hi").select("_src", F.floor(F.col("u") / BLOCKS).cast("int").alias("pass"), (F.col("u") % BLOCKS).cast("int").alias("block"), "shard")
    out = shared.written(out, "mix-units")
    shared.drop(node)
    return out


def _shard(shards: int) -> Column:
    """A row's shard: its unit's; for the row that closes a source's gap, whose block may be no unit, and for rows of
    one hash that are taken in part, that of a hash."""
    own = F.pmod(F.xxhash64("_h", F.coalesce("_lone", F.lit(0).cast("long"))), F.lit(shards)).cast("int")
    return F.when(F.col("_lone").isNotNull(), own).otherwise(F.coalesce("shard", own))


def mix_report(docs: DataFrame, seed: int = 1, shards: int = 16) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, shard) for each row of ``docs`` (doc_id, source, text).

    ``taken`` is the words that the mix takes of the row, its copies counted; ``shard`` is its first copy's output
    shard (null if none is taken).  A null or empty text has size 0 and is not taken.  Rows with a null doc_id are
    placed like others.  Of rows that agree in every column some may be taken once more than others.  Very long texts
    count whole: the words taken of a source are off its target by less than its longest text.  Sources that tie share
    alike.  An empty table gives no rows.
    """
    sizes = shared.written(_sized(docs, seed), "mix-sizes")
    sources, leaf, split = plan(sizes)
    r = _copies(sizes, sources, leaf, split)
    unit = units(sources, shards, seed)
    first = unit.where("pass = 0").select("_src", "block", "shard")
    r = r.withColumn("block", F.floor(F.col("_l1") / (FINE // BLOCKS)).cast("int")).join(first, ["_src", "block"], "left")
    out = r.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies", F.when(F.col("copies") > 0, _shard(shards)).alias("shard"))
    out = shared.written(out, "mix-report")
    shared.drop(sizes, sources, leaf, split, unit)
    return out


def mix(docs: DataFrame, seed: int = 1, shards: int | None = None) -> DataFrame:
    """The mixed rows of ``docs``, all columns kept, each copy a row, dealt to ``shards`` partitions and shuffled
    within each.  Rows of ``docs`` that the mix does not take are absent.  See ``mix_report`` for odd rows."""
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = 1 << (shards - 1).bit_length()
    names = docs.columns
    sizes = shared.written(_sized(docs, seed), "mix-sizes")
    sources, leaf, split = plan(sizes)
    shared.drop(sizes)
    rows = _copies(_sized(docs, seed, keep=True), sources, leaf, split).where("copies > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("block", F.floor(F.col("_l1") / (FINE // BLOCKS)).cast("int"))
    dealt = rows.join(units(sources, shards, seed), ["_src", "pass", "block"], "left").withColumn("shard", _shard(shards))
    local = F.xxhash64(F.lit(seed + 7), "_h", "pass", F.coalesce("_lone", F.lit(0).cast("long")))
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", local, "doc_id").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
