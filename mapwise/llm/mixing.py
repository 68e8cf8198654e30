"""Mix sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapwise.llm.storage import stored
from mapwise.llm.words import WORD_PATTERN

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of the hash that each histogram level resolves, and all levels; md5 gives 60 bits in 15 hex digits.
LEVEL_BITS, LEVELS = 12, 5


def mix_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Target size of each source: ``share`` of all sizes dealt by weight, at most ``most`` times the source's size.

    ``sizes`` has one row per source (source, source_size), so the one window below sorts sources, not documents.
    What a stopped source cannot take goes to the others by weight. Sources stop in the order of size per weight,
    so the level of the rest follows from running sums. Sources of size 0 have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    level = (F.col("budget") - F.col("stopped_before")) / F.col("weight_left")
    return (
        sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("stopped_before", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("level", level)
        .withColumn("open", most * F.col("source_size") > F.col("weight") * F.col("level"))
        .withColumn("final", F.max(F.when(F.col("open"), F.struct(-F.col("stopped_before"), "level"))).over(every)["level"])
        .select(
            "source", "source_size",
            F.when(F.col("open"), F.col("weight") * F.col("final"))
            .otherwise((most * F.col("source_size")).cast("double")).alias("target"),
        )
    )


def hash_of(doc_id: Column, text: Column) -> Column:
    """60-bit hash of a document's id and text; the same in every run. Null ids and texts hash as empty ones."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def extra_below(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source, the hash up to which documents are taken to come nearest to the budget: (source, threshold).

    ``sized`` has (source, hash, size), ``budgets`` (source, budget). Level by level, sizes are summed by source
    and hash bucket; whole buckets are taken while their running sum fits, and only the first bucket that does not
    fit is resolved further, by the next ``LEVEL_BITS`` bits. A window therefore holds at most 2**12 buckets of a
    source, and documents are never sorted. Rows of one hash are taken together or not at all.
    """
    # Per source: buckets fixed so far, and the budget that is left within the boundary bucket.
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    done = None
    for n in range(1, LEVELS + 1):
        shift = (LEVELS - n) * LEVEL_BITS
        bucket = F.shiftright("hash", shift)
        rows = sized.join(state, sized["source"].eqNullSafe(state["source"])).drop(state["source"])
        inside = rows.filter(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "left", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("running", running).filter(F.col("running") > F.col("left"))
        found = over.groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("left") - (F.col("running") - F.col("size"))).alias("left"), "size")).alias("edge")
        ).select("source", F.col("edge.bucket").alias("prefix"), "edge.left", F.col("edge.size").alias("edge_size"))
        if n == 1:
            found = stored(found, "mix-edges")
            # A source whose budget takes all of it has no boundary at all.
            whole = budgets.join(found, budgets["source"].eqNullSafe(found["source"]), "left_anti")
            done = whole.select("source", F.lit((1 << 60) - 1).cast("long").alias("threshold"))
        elif n < LEVELS:
            found = stored(found, "mix-edges")
        state = found
    # Everything below the boundary value fits; the value itself goes in where that ends nearer to the budget.
    nearer = F.col("edge_size") - F.col("left") < F.col("left")
    return done.unionByName(state.select("source", (F.col("prefix") - F.when(nearer, 0).otherwise(1)).alias("threshold")))


def _sized(docs: DataFrame) -> DataFrame:
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD_PATTERN)))
    return stored(
        docs.select("doc_id", "source", words.cast("long").alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")),
        "mix-sizes",
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2
) -> DataFrame:
    """How often each document is taken: (doc_id, source, size, source_size, target, copies, taken).

    A document's size is its number of words (null text: 0). Each is taken ``floor(target / source size)`` times,
    and once more up to the place, in the order of the hashes of ids and texts, where the running size of its source
    comes nearest to the rest of the target: a source misses its target by at most half of one document (of one group of
    rows equal in id and text; null or repeated ids alone do not bind rows together). Null sources are one source, last in order. Only ``doc_id``, ``text`` and ``source`` are read, so
    other columns may have any name. Repeated rows each count and share their decision; an empty table gives none.
    A hot source only adds to per-task partial sums: no step gathers its documents.
    """
    sized = _sized(docs)
    plan = mix_plan(sized, weights, share, most)
    return (
        sized.join(plan, sized["source"].eqNullSafe(plan["of_source"]))
        .withColumn("copies", copies_of(F.col("hash"), F.col("plan"), most))
        .select("doc_id", "source", "size", "plan.source_size", "plan.target", "copies",
                (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(of_source, plan): each source's size and target, whole rounds, and the hash up to which documents go once more.

    ``sized`` has (source, hash, size). One row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(mix_targets(totals, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole)
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    limits = extra_below(sized.select("source", "hash", "size"), budgets)
    plan = targets.join(limits, targets["source"].eqNullSafe(limits["source"])).drop(limits["source"])
    return plan.select(
        F.col("source").alias("of_source"), F.struct("source_size", "target", "whole", "threshold").alias("plan"))


def copies_of(hash: Column, plan: Column, most: int = 2) -> Column:
    return F.least(plan["whole"] + (hash <= plan["threshold"]).cast("long"), F.lit(most).cast("long"))


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2
) -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it; only the plan of the sources is joined, so no text
    is shuffled."""
    plan = stored(mix_plan(_sized(docs), weights, share, most), "mix-plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(plan, F.col("row.source").eqNullSafe(F.col("of_source")))
    times = copies_of(hash_of(F.col("row.doc_id"), F.col("row.text")), F.col("plan"), most).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


MIX_SQL = r"""
with sized as (
  select doc_id, source, cast(case when text is null then 0 else
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
totals as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place
  from sized group by source),
weighed as (select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from totals),
runs as (
  select *, 1.5::double * sum(source_size) over () as budget,
         coalesce(sum(2 * source_size) over (order by source_size::double / weight, place
           rows between unbounded preceding and 1 preceding), 0) as before,
         sum(weight) over (order by source_size::double / weight, place
           rows between current row and unbounded following) as weight_left
  from weighed),
levels as (select *, (budget - before::double) / weight_left::double as lvl from runs),
marked as (select *, 2 * source_size > weight * lvl as open from levels),
targets as (
  select source, source_size,
         case when open then weight * (select lvl from marked where open order by before limit 1)
              else (2 * source_size)::double end as target
  from marked),
plans as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
run as (
  select s.doc_id, s.size, p.source_size, p.target, p.whole, target - whole * source_size as budget,
         sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as used,
         sum(s.size) over (partition by s.source, s.h) as own
  from sized s join plans p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       cast(size * least(whole + case when used <= budget
              or (used - own <= budget and used - budget < budget - (used - own)) then 1 else 0 end, 2) as bigint) as taken
from run
"""
