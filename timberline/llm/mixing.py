"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A source whose target is c times its words takes each of its documents floor(c) times, and once more with the fractional
probability. The fractions are rounded in pairs: words of probability mass go from one document to the other, in a random
direction that keeps each one's expectation, until one of the two is taken or left for good. The other one goes on to
the next pair. Blocks of a source are folded like this on their own, each leaves one document with a fraction at most,
and those residuals are folded again, level by level, until a source has one residual; that one is rounded to the nearer
side, and one document of the last fold may change sides to come still nearer. So a source misses its target by half a
document at most, and a block never holds more than a few hundred documents however large its source is. Every random
number is a hash of document ids, so reruns agree.

Defined results: null and blank texts have size 0 and take 0. The null source comes last. A source of size 0 has target 0.
Repeated rows are rounded one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD, carrying, cut, keyed_rows

#: Documents of a block, on average.
BLOCK = 192
_ITEM = "struct<o:bigint,h:bigint,doc_id:bigint,size:bigint,mass:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,up:bigint>>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, size).

    The sources in code point order (null last) have ``weights``, repeating, and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again. One row per source is sorted in one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("double")
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return sources.withColumn("level", level).withColumn("target", F.least(F.col("cap"), F.col("w") * F.max("level").over(whole))).select("source", "source_size", "target")


def _fold(seed: int) -> str:
    """SQL that folds the array ``items``: the residual (size 0: none) and the documents that are decided."""
    shift = "if(u * (least(a.size - a.mass, b.mass) + least(a.mass, b.size - b.mass)) < least(a.mass, b.size - b.mass), least(a.size - a.mass, b.mass), -least(a.mass, b.size - b.mass))"
    for x in "ab":
        shift = shift.replace(f"{x}.size", f"v.{x}.size").replace(f"{x}.mass", f"v.{x}.mass")
    shift = shift.replace("u *", f"shiftrightunsigned(xxhash64(v.a.h, v.b.h, {seed}), 11) * 1.1102230246251565D-16 *".replace("D-16", "E-16"))
    item = lambda x, mass: f"named_struct('o', {x}.o, 'h', {x}.h, 'doc_id', {x}.doc_id, 'size', {x}.size, 'mass', {mass})"
    over = lambda x, mass: f"({mass} <= 1e-9 * {x}.size or {mass} >= (1 - 1e-9) * {x}.size)"
    done = lambda x, mass: f"if({over(x, mass)}, array(named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'up', cast({mass} * 2 > {x}.size as bigint))), cast(array() as {_DONE}))"
    ma, mb = "(t.v.a.mass + t.x)", "(t.v.b.mass - t.x)"
    merged = f"""transform(transform(array(named_struct('a', acc.cur, 'b', e)), v -> named_struct('v', v, 'x', {shift})), t -> named_struct(
        'cur', if(not {over("t.v.a", ma)}, {item("t.v.a", ma)}, if(not {over("t.v.b", mb)}, {item("t.v.b", mb)}, {item("t.v.b", "0D")})),
        'empty', {over("t.v.a", ma)} and {over("t.v.b", mb)},
        'done', concat(acc.done, {done("t.v.a", ma)}, {done("t.v.b", mb)})))[0]"""
    none = f"cast(null as {_ITEM})"
    return f"aggregate(items, named_struct('cur', {none}, 'empty', true, 'done', cast(array() as {_DONE})), (acc, e) -> if(acc.empty, named_struct('cur', e, 'empty', false, 'done', acc.done), {merged}))"


def _close() -> str:
    """SQL for a group's last fold ``f``: its decided documents, the residual rounded to the nearer side among them. One
    document whose size comes nearest to what the group then misses changes sides, if the group misses less so."""
    miss = "if(f.empty, 0D, if(f.cur.mass * 2 > f.cur.size, f.cur.size - f.cur.mass, -f.cur.mass))"
    best = "array_min(filter(transform(f.done, (d, i) -> named_struct('far', abs(abs(m) - d.size), 'i', i, 'up', d.up)), x -> x.far < abs(m) and x.up = if(m > 0, 1, 0)))"
    last = f"if(f.empty, cast(array() as {_DONE}), array(named_struct('doc_id', f.cur.doc_id, 'size', f.cur.size, 'up', cast(f.cur.mass * 2 > f.cur.size as bigint))))"
    return f"concat(transform(array({miss}), m -> transform(array({best}), b -> transform(f.done, (d, i) -> named_struct('doc_id', d.doc_id, 'size', d.size, 'up', if(i <=> b.i, 1 - d.up, d.up))))[0])[0], {last})"


def pivotal_round(items: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """grp, doc_id, size, up (0 or 1) of ``items`` (grp, doc_id, size, p): in each group the words taken, the sum of
    size * up, miss the sum of size * p by half a document at most. ``size`` is positive and ``p`` between 0 and 1."""
    h = F.xxhash64("doc_id", "size", F.lit(seed))
    live = items.select("grp", F.struct((-F.col("size")).alias("o"), h.alias("h"), "doc_id", "size", (F.col("size") * F.col("p")).alias("mass")).alias("item"))
    out, level = None, 0
    while True:
        counts = live.groupBy(F.col("grp").alias("own")).agg(F.ceil(F.count("*") / block).alias("blocks"))
        joined = live.join(counts, F.col("grp").eqNullSafe(F.col("own"))).select("grp", "item", F.pmod(F.xxhash64("item.h", F.lit(seed + level)), F.col("blocks")).alias("block"), "blocks")
        folded = joined.groupBy("grp", "block").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("blocks").alias("blocks"))
        folded = cut(folded.select("grp", "blocks", F.expr(_fold(seed + level)).alias("f")))
        closed = F.expr(f"if(blocks = 1, {_close()}, f.done)")
        done = folded.select("grp", F.explode(closed).alias("d")).select("grp", "d.doc_id", "d.size", "d.up")
        out = done if out is None else out.unionByName(done)
        rest = folded.filter("not f.empty")
        live = rest.filter("blocks > 1").select("grp", F.col("f.cur").alias("item"))
        if live.isEmpty():
            return out
        level += 1


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of ``docs`` (doc_id, text, source).

    Rows are told apart by a key of their own, so equal ids don't meet in one block.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    rows = keyed_rows(counted.withColumn("text", F.concat_ws(" ", "source", "size")))
    sizes = rows.select("source", "size", F.col(ROW).alias("key"), "doc_id")
    targets = cut(source_targets(sizes, weights, share, most))
    named = targets.withColumnRenamed("source", "own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = F.floor(rate + 1e-12)
    p = F.greatest(rate - full, F.lit(0.0))
    rated = sizes.join(named, F.col("source").eqNullSafe(F.col("own"))).select("source", "key", "size", full.alias("full"), p.alias("p"))
    split = (F.col("size") > 0) & (F.col("p") > 1e-12)
    rounded = pivotal_round(rated.filter(split).select(F.col("source").alias("grp"), F.col("key").alias("doc_id"), "size", "p"), seed)
    ups = rated.filter(~split).select("source", "key", "size", F.lit(0).cast("long").alias("up")).unionByName(rounded.withColumnsRenamed({"grp": "source", "doc_id": "key"}))
    back = named.withColumn("full", full)
    taken = ups.join(back, F.col("source").eqNullSafe(F.col("own"))).select("key", "size", "source_size", "target", (F.col("size") * (F.col("full") + F.col("up"))).cast("long").alias("taken"), (F.col("full") + F.col("up")).cast("int").alias("copies"))
    if _keys_are_ids(rows):
        return taken.withColumnRenamed("key", "doc_id")
    return taken.join(sizes.select("key", "doc_id"), "key").select("doc_id", "size", "source_size", "target", "taken", "copies")


def _keys_are_ids(rows: DataFrame) -> bool:
    """Whether no row's key differs from its doc_id."""
    return rows.filter(~F.col(ROW).eqNullSafe(F.col("doc_id"))).isEmpty()


def query(docs: DataFrame) -> DataFrame:
    """The columns of ``op5``: doc_id, size, source_size, target, taken, copies."""
    return mix_sources(docs)


@carrying
def stage(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it."""
    rows = keyed_rows(docs)
    mixed = mix_sources(rows.select(F.col(ROW).alias("doc_id"), "text", "source"))
    taken = rows.join(mixed.select(F.col("doc_id").alias(ROW), F.col("copies").alias("_tl_copies")).filter("_tl_copies > 0"), ROW)
    return taken.withColumn("_tl_copy", F.explode(F.expr("sequence(1, _tl_copies)"))).select(*docs.columns)
