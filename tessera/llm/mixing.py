"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: sources in code-point order weigh 5, 2, 1, repeating, and share a total; a target stops at CAP times its
source's size and the excess goes to the others by weight. That fixed point is min(CAP * size, level * weight) with one level for all, found by
ordering the sources by CAP * size / weight and summing.

Selection within a source: as many complete epochs as fit the target, then a fraction of one more: each document draws a key
-ln(u) / w with w its quality weight and u from a hash of its id and text, and documents are taken whole in key order up to the budget, the
one that crosses it up to the word.

A source's documents are never in one task: keys are cut into slices of about SLICE documents, sizes are summed per slice before any
shuffle of documents, and documents are only ordered within their slice. Slices are prefix-summed in two levels, within a block of BLOCK of them and
block by block, so a task sees a source's blocks (one for SLICE * BLOCK documents) or the slices of a block. Documents that share id and text
draw the same key and stay in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _common as C

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
SLICE, BLOCK = 500, 1000
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """The number of words; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 48 bits of an MD5 of the id and the text's MD5 (null: that of the empty text)."""
    named = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def quality_weight(text: Column, size: Column) -> Column:
    """4 for a text whose words have 2 to 12 characters on average, white space included, and few symbols; 1 otherwise."""
    chars = F.length(text)
    plain = F.length(F.translate(text, "#$%&*|!{}<>", ""))
    return F.when((size > 0) & (chars >= 2 * size) & (chars <= 12 * size) & (20 * (chars - plain) <= chars), 4).otherwise(1)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size); one row a source, so the windows here hold sources, not documents."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1))
    by_ratio = Window.orderBy((F.lit(float(CAP)) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        # the level if just the sources before this one stopped at their cap
        ((F.lit(SHARE) * F.sum("source_size").over(whole) - CAP * F.coalesce(F.sum("source_size").over(up_to), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))).alias("level"),
    )
    # the first source, in that order, that the level leaves below its cap sets it for all behind it
    below = F.when(F.col("level") * F.col("weight") <= CAP * F.col("source_size"), F.col("level"))
    level = F.first(below, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", F.least(F.lit(float(CAP)) * F.col("source_size"), F.coalesce(level, F.lit(float(CAP))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted); one row for a row.

    A null text has size 0 and takes nothing; null is a source, the last. Rows of equal ids and texts draw equal keys; which of them takes more is
    left open. A very long text is counted whole. Other columns, whatever their names, are not read; an empty table gives an empty one. The sum of ``taken`` in a source is its target rounded down.
    """
    return _taken(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))).select("doc_id", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, *keep: str) -> DataFrame:
    """From ``docs`` (doc_id, text, source and what ``keep`` names): doc_id, source, ``keep``, size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", *keep, F.col("text").alias("_text"), size_of(F.col("text")).alias("size"))
    keyed = sized.select("doc_id", "source", *keep, "size", (-F.log(uniform(F.col("doc_id"), F.col("_text"))) / quality_weight(F.col("_text"), F.col("size"))).alias("draw"))
    drawn = C.stored(keyed.select("doc_id", "source", "size", "draw"), "mix-draws")
    slices = max(1, -(-drawn.count() // SLICE))
    # exp(-draw) lies in (0, 1) and falls with the draw, so slices follow the order of the draws
    slice_of = F.floor((1 - F.exp(-F.col("draw"))) * slices).cast("long")
    per_slice = drawn.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("slice_size"))
    goals = targets(per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    per_slice = per_slice.withColumn("block", F.floor(F.col("slice") / BLOCK).cast("long"))
    per_block = per_slice.groupBy("source", "block").agg(F.sum("slice_size").alias("block_size"))
    blocks = per_block.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), (F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")).alias("before_block"))
    in_order = Window.partitionBy("source", "block").orderBy("slice")
    per_slice = per_slice.withColumn("before_slice", F.sum("slice_size").over(in_order) - F.col("slice_size"))
    per_slice = per_slice.join(blocks, (F.col("block") == F.col("b_block")) & F.col("source").eqNullSafe(F.col("b_source"))).withColumn("before_slice", F.col("before_slice") + F.col("before_block"))
    joined = per_slice.join(goals, per_slice["source"].eqNullSafe(goals["source"])).select(per_slice["source"].alias("s_source"), F.col("slice").alias("s_slice"), "before_slice", "source_size", "target")
    rows = (keyed if keep else drawn).withColumn("slice", slice_of).join(joined, (F.col("slice") == F.col("s_slice")) & F.col("source").eqNullSafe(F.col("s_source")))
    within = Window.partitionBy("s_source", "s_slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    before = F.col("before_slice") + F.sum("size").over(within) - F.col("size")
    return (
        rows.withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - before)))
        .select("doc_id", "source", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``documents``: each document as often as its whole size was taken, and once
    more cut to the words that are left over, if any (words joined by single spaces there). Documents without words are not in it."""
    taken = _taken(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")), "row").where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    dealt = taken.select("row", F.explode(copies).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({C.WORD})"), F.lit(1)), 1, F.greatest(F.col("words"), F.lit(0))), " ")
    dealt = dealt.select("row", F.when(F.col("words") < 0, F.col("row.text")).otherwise(first).alias("new_text"))
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text")}
    return dealt.select(*[made.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op5_source_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         length(text) as chars, length(translate(text, '#$%&*|!{}<>', '')) as plain,
         (('0x' || substr(md5('mix-1' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents),
keyed as (
  select doc_id, source, size,
         -ln(u) / (case when size > 0 and chars >= 2 * size and chars <= 12 * size and 20 * (chars - plain) <= chars then 4 else 1 end) as draw
  from sized),
sizes as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from keyed group by source),
levels as (
  select *, row_number() over (order by 2.0::double * source_size / weight, source nulls last) as place,
         (1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over before, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from sizes
  window before as (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
chosen as (select level from levels where level * weight <= 2 * source_size order by place limit 1),
goals as (
  select source, source_size, least(2.0::double * source_size, coalesce((select level from chosen), 2.0) * weight) as target from levels),
placed as (
  select k.doc_id, k.size, g.source_size, g.target,
         case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end::bigint as epochs,
         sum(k.size) over (partition by k.source order by k.draw, k.doc_id, k.size rows between unbounded preceding and current row) - k.size as prior
  from keyed k join goals g on k.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - prior)))::bigint as taken
from placed
"""
}
