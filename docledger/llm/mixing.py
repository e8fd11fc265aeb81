"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm._spark import Tables, checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
ROUNDS = 2


def source_targets(sizes: DataFrame, budget: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of sources: (source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, get the weights in turn. The budget times all words is shared by weight;
    no target exceeds `most` times its source's size, and what is over is shared again by weight. Sorted by size over
    weight the capped sources form a prefix, so running sums find the final share without a loop. The input has one
    row for each source, which is why windows over all of it are in order.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    return (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("cap", cap.cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("left", F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
        .withColumn("share", F.max(F.when(~F.col("full"), F.col("left") / F.col("weights"))).over(everything))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))
    )


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def measure(size: Column, weight: Column | None) -> Column:
    """What inclusion probabilities are proportional to, cut to three digits, so that a source has few different values."""
    value = size if weight is None else F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0))
    unit = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - value % unit


def scales(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """(s, scale): the factor by which a source's measures give inclusion probabilities whose documents add up to its quota.

    Probabilities end at 1: the documents of the largest measures are certain, and the scale is that of the others.
    Sought among the different measures of a source, some thousands at most, by running sums.
    """
    by_measure = sized.filter("measure > 0").groupBy("source", "measure").agg(F.sum("size").cast("decimal(38,0)").alias("words"))
    upto = Window.partitionBy("source").orderBy("measure").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("source").orderBy(F.desc("measure")).rowsBetween(Window.unboundedPreceding, -1)
    sums = by_measure.withColumns({"weighed": F.sum(F.col("words") * F.col("measure").cast("decimal(20,0)")).over(upto).cast("double"), "certain": F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")})
    tried = sums.join(quotas.select(F.col("s"), "quota"), F.col("source").eqNullSafe(F.col("s"))).withColumn("scale", (F.col("quota") - F.col("certain")) / F.col("weighed"))
    fitting = tried.filter((F.col("weighed") > 0) & (F.col("scale") * F.col("measure") <= 1))
    return fitting.groupBy("s").agg(F.max(F.struct("measure", "scale")).alias("best")).select(F.col("s").alias("of"), F.col("best.scale").alias("scale"))


def filled(rows: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Takes documents in the order of their key while they fit into what their source's quota lacks; those that alone are larger are passed over.

    A source is never gathered: running sums go over bins of the key first, and rows are only sorted within the one bin
    in which a source's quota ends.
    """
    source = F.col("source").eqNullSafe(F.col("s"))
    lacking = rows.groupBy("source").agg((F.max("quota") - F.sum(F.when(F.col("first"), F.col("size")).otherwise(0))).alias("missing"))
    missing = tables.write(lacking.withColumnRenamed("source", "s"), f"{name}-missing")
    rows = rows.join(missing, source, "left").drop("s").withColumn("open", ~F.col("first") & F.col("bin").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("missing")))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("before") + F.col("words") > F.col("bin_missing")
    bins = tables.write(
        rows.filter("open").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("missing").alias("bin_missing"))
        .withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .withColumn("state", F.when(~ends, 1).when(F.col("before") <= F.col("bin_missing"), 0).otherwise(-1))
        .select(F.col("source").alias("s"), F.col("bin").alias("b"), "before", "state"),
        f"{name}-bins",
    )
    # a bin is within the sample, holds its end, or is beyond it; only rows of the second kind are sorted
    binned = rows.join(bins, source & (F.col("bin") == F.col("b")) & F.col("open"), "left").drop("s", "b")
    rank = Window.partitionBy("source", "bin").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    at_end = binned.filter("state = 0").withColumn("upto", F.col("before") + F.sum("size").over(rank)).withColumn("first", F.col("upto") <= F.col("missing")).drop("upto")
    others = binned.filter("state is null or state <> 0").withColumn("first", F.col("first") | F.coalesce(F.col("state") == 1, F.lit(False)))
    out = checkpoint(at_end.unionByName(others).drop("missing", "open", "before", "state"))
    tables.drop(f"{name}-missing")
    tables.drop(f"{name}-bins")
    return out


def mix_sources(
    docs: DataFrame, budget: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None
) -> DataFrame:
    """Chooses how many words of each document a mix takes, so that each source comes near its target.

    Of a source whose target is t times its words, every document gets floor(t) whole copies. The rest of the target, its
    quota, is a sample without replacement with unequal probabilities: they are proportional to the document's size, or
    to the whole number in `weight_col` (null or negative: 0), so scaled that the sample is expected to fill the quota;
    documents whose probability would pass 1 are certain. Documents are ranked by random odds over inclusion odds
    (Pareto order sampling) and taken in that order while they fit. Those too large for what is missing are passed over,
    once more from the top, and the words then still missing are made up by the document of nearest size.

    Returns id, source, size, source_size, target, copies, chance (the inclusion probability; null: not to be sampled),
    sampled, taken. Sizes are runs of non-space characters. A null text has size 0 and takes 0; null sources form a
    source; repeated ids are separate documents; an empty table gives none. A very long text is one document like others.
    Other columns of `docs` are not read, so their names don't matter.
    """
    # tables of a row for each source or bin are written, so that Spark knows their size and need not deal documents out by source
    tables = Tables(docs.sparkSession, "mix")
    sized = checkpoint(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (F.lit(None) if weight_col is None else F.col(weight_col)).alias("weight"),
        )
        .withColumn("measure", measure(F.col("size"), None if weight_col is None else F.col("weight"))).drop("weight")
        .withColumn("random", uniform(F.col("id"), seed))
        .withColumn("row", F.monotonically_increasing_id())
    )
    sums = tables.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    quotas = tables.write(
        source_targets(sums, budget, weights, most)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("quota", F.col("target") - F.col("copies") * F.col("source_size"))
        .select(F.col("source").alias("s"), "source_size", "target", "copies", "quota"),
        "quotas",
    )
    plan = tables.write(quotas.join(scales(sized, quotas), F.col("s").eqNullSafe(F.col("of")), "left").drop("of"), "plan")
    chance = F.least(F.col("scale") * F.col("measure"), F.lit(1 - 1e-12))
    rows = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("chance", F.when((F.col("quota") > 0) & (F.col("measure") > 0), chance))
        .withColumn("key", F.col("random") / (1 - F.col("random")) / (F.col("chance") / (1 - F.col("chance"))))
        .withColumn("bin", F.floor(F.lit(BINS) * (F.col("key") / (1 + F.col("key")))).cast("int"))
        .select("id", "source", "size", "source_size", "target", "copies", "quota", "chance", "key", "bin", "row", F.lit(False).alias("first"))
    )
    for n in range(ROUNDS):
        rows = filled(rows, tables, str(n))
    missing = rows.groupBy("source").agg((F.max("quota") - F.sum(F.when(F.col("first"), F.col("size")).otherwise(0))).alias("missing"))
    missing = tables.write(missing.withColumnRenamed("source", "s"), "missing")
    near = F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "key", "id", "size", "row")
    spare = tables.write(
        rows.filter(~F.col("first") & F.col("key").isNotNull() & (F.col("size") > 0))
        .join(missing, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("size") < 2 * F.col("missing"))
        .groupBy("source").agg(F.min(near).alias("best"))
        .select(F.col("source").alias("s"), F.col("best.row").alias("extra")),
        "spare",
    )
    for part in ("sums", "quotas", "plan", "missing"):
        tables.drop(part)
    sampled = F.col("first") | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))
    taken = F.col("size") * (F.col("copies") + sampled.cast("long"))
    return rows.join(spare, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "chance", sampled.alias("sampled"), taken.alias("taken")
    )


ROUND_SQL = """
m{n} as (select source, max(quota) - sum(case when first then size else 0 end) as missing from c{before} group by source),
o{n} as (select c.*, m.missing, not first and key is not null and size > 0 and size <= m.missing as open from c{before} c join m{n} m on c.source is not distinct from m.source),
c{n} as (select * exclude (missing, open, first), first or (open and sum(size) over (partition by source, open order by key, doc_id, size, rw rows unbounded preceding) <= missing) as first from o{n}),"""

#: The same mix in DuckDB SQL, for the defaults; {docs} is a relation of doc_id, text, source.
SQL = (
    r"""
with counted as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as random,
    row_number() over () as rw
  from {docs}),
sized as (select *, size - size % cast(pow(10, greatest(length(cast(size as varchar)) - 3, 0)) as bigint) as measure from counted),
sums as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source asc nulls last) - 1) % 3] as weight, (2 * source_size)::double as cap from sums),
x as (select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as lft,
    sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as weights from w),
y as (select *, cap * weights <= lft * weight as full_up from x),
z as (select *, max(case when not full_up then lft / weights end) over () as share from y),
targets as (select source, source_size, case when full_up then cap else share * weight end as target from z),
plan as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as copies from targets),
quotas as (select *, target - copies * source_size as quota from plan),
measures as (select source, measure, sum(size) as words from sized where measure > 0 group by 1, 2),
tried as (
  select m.source, measure, (quota - coalesce(sum(words) over (partition by m.source order by measure desc rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(words * measure) over (partition by m.source order by measure rows between unbounded preceding and current row))::double as scale
  from measures m join quotas q on m.source is not distinct from q.source),
scaled as (select source, arg_max(scale, measure) as scale from tried where scale * measure <= 1 group by source),
odds as (
  select d.doc_id, d.source, d.size, d.rw, d.random, q.source_size, q.target, q.copies, q.quota, case when q.quota > 0 and measure > 0 then least(s.scale * measure, 1 - 1e-12::double) end as chance
  from sized d join quotas q on d.source is not distinct from q.source left join scaled s on d.source is not distinct from s.source),
c0 as (select *, random / (1 - random) / (chance / (1 - chance)) as key, false as first from odds),"""
    + "".join(ROUND_SQL.format(n=n + 1, before=n) for n in range(ROUNDS))
    + """
missing as (select source, max(quota) - sum(case when first then size else 0 end) as missing from c{rounds} group by source),
spare as (
  select source, rw as extra from (
    select c.source, c.rw, row_number() over (partition by c.source order by abs(c.size - m.missing), c.key, c.doc_id, c.size, c.rw) as n
    from c{rounds} c join missing m on c.source is not distinct from m.source
    where not c.first and c.key is not null and c.size > 0 and c.size < 2 * m.missing) where n = 1)
select c.doc_id, c.size, c.source_size, c.target, c.size * (c.copies + case when c.first or c.rw = s.extra then 1 else 0 end) as taken
from c{rounds} c left join spare s on c.source is not distinct from s.source
""".replace("{rounds}", str(ROUNDS))
)
