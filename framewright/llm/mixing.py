"""Mixing sources by temperature, with DataFrame functions only.

A source's share of all tokens, raised to an exponent and normalised, is its
weight. The exponent is bisected on a fixed grid to meet a target entropy or a
limit on repetition. A weight of a budget of tokens is realised as passes over
the source, each a block in a permutation of its own: as many whole passes as
the budget holds, and of one more the first documents up to the tokens left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import stored, table

#: Steps of the exponent between 0 and 1; a power of SECTIONS.
GRID = 4096
#: Parts that an interval of exponents is cut into at a time.
SECTIONS = 16
#: Bits of a place in a permutation, and those of them that number its cells.
PLACE_BITS, CELL_BITS = 48, 10
#: Sources up to which the plan is broadcast.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet.

    repetition: the smallest exponent at which no source is passed over more
    than so many times. entropy: the largest exponent at which the weights
    have at least this share of the largest possible entropy. Where no
    exponent from 0 to 1 meets it, 1 and 0 are taken.
    """

    kind: str
    value: float


def n_tokens() -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: int, number: Column) -> Column:
    """Where a document stands in a pass: 48 bits of md5 of seed, pass and doc_id."""
    name = F.concat_ws("|", F.lit(str(seed)), number.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, PLACE_BITS // 4), 16, 10).cast("long")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens of every row: the texts are read once, and this narrow table serves the rest."""
    return stored(docs.select("doc_id", "source", n_tokens().alias("n_tokens")), "mixing")


def exponent(totals: DataFrame, target: Target, budget: int | None) -> float:
    """The exponent that meets the target, for ``totals(tokens)``, one row for each source that has any.

    An interval of the grid is cut into sections, all judged by one aggregate
    over the sources, and the section that holds the answer is cut again.
    """
    row = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    if not row["n"]:
        return 1.0
    q = F.col("tokens") / F.lit(float(row["all"]))
    low, step = 0, GRID
    while step > 1:
        step //= SECTIONS
        grid = F.explode(F.array(*(F.lit(low + k * step) for k in range(SECTIONS + 1)))).alias("g")
        a = F.col("g") / F.lit(float(GRID))
        sums = totals.select("tokens", grid).groupBy("g").agg(F.sum(F.pow(q, a)).alias("z"), F.sum(F.pow(q, a) * F.log(q)).alias("s"), F.max(F.pow(q, a) / F.col("tokens")).alias("most"), F.min(F.pow(q, a) / F.col("tokens")).alias("least"))
        if target.kind == "entropy":
            meets = F.log("z") - a * F.col("s") / F.col("z") >= F.lit(target.value) * F.log(F.lit(float(row["n"]))) - 1e-9
        elif target.kind == "repetition":
            repeats = F.col("most") / F.col("least") if budget is None else F.lit(float(budget)) * F.col("most") / F.col("z")
            meets = repeats <= F.lit(target.value) + 1e-9
        else:
            raise ValueError(target.kind)
        met = {r["g"] for r in sums.filter(meets).select("g").collect()}  # 17 rows at most
        points = range(low, low + SECTIONS * step + 1, step)
        if target.kind == "entropy":  # met up to some point
            low = max((g for g in points if g in met), default=0)
            last = low
        else:  # met from some point on
            last = min((g for g in points if g in met), default=GRID)
            low = max(0, last - step)
        low = min(low, GRID - step)
    return last / GRID


def plan(counts: DataFrame, target: Target, budget: int | None = None, seed: int = 0) -> DataFrame:
    """source, tokens, weight, whole (passes), rest (tokens of one more), last_place: who is in the last pass stands up to there, null if nobody.

    One row for each source. A null source is a source of its own; one
    without tokens gets one whole pass and the weight 0. Without a budget it is
    the least one that passes over every source once. Hot sources are summed
    cell by cell of the permutation; only the rows of the one cell in which
    the budget ends are put in order.
    """
    totals = stored(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mixing")
    having = totals.filter("tokens > 0")
    a = F.lit(exponent(having, target, budget))
    row = having.agg(F.coalesce(F.sum("tokens"), F.lit(1)).alias("all")).first()
    power = F.pow(F.col("tokens") / F.lit(float(row["all"])), a)
    norm = having.agg(F.sum(power).alias("z"), F.min(power / F.col("tokens")).alias("least")).first()
    passes = power / F.col("tokens") / F.lit(norm["least"]) if budget is None else power / F.lit(norm["z"]) * F.lit(float(budget)) / F.col("tokens")
    some = F.col("tokens") > 0
    shares = totals.select("source", "tokens", F.when(some, F.round(power / F.lit(norm["z"] or 1.0), 9)).otherwise(0.0).alias("weight"), F.when(some, F.round(passes, 9)).otherwise(1.0).alias("passes"))
    shares = shares.select("source", "tokens", "weight", F.floor("passes").alias("whole"), F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("rest"))
    shares = stored(shares, "mixing")
    small = F.broadcast(shares) if shares.count() <= BROADCAST_SOURCES else shares
    last = counts.filter("n_tokens > 0").join(small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).filter("rest > 0")
    last = last.select("source", "rest", "n_tokens", place(seed, F.col("whole")).alias("place"))
    last = last.withColumn("cell", F.shiftright("place", PLACE_BITS - CELL_BITS))
    cells = last.groupBy("source", "cell").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = cells.withColumn("before", before).filter("before < rest and before + n >= rest").select(F.col("source").alias("__source"), F.col("cell").alias("__cell"), "before")
    in_cell = last.join(F.broadcast(ends) if isinstance(small, DataFrame) and small is not shares else ends, F.col("source").eqNullSafe(F.col("__source")) & (F.col("cell") == F.col("__cell")))
    so_far = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = in_cell.withColumn("so_far", F.col("before") + so_far).filter("so_far < rest").groupBy(F.col("source").alias("__source")).agg(F.max("place").alias("last_place"))
    return stored(shares.join(top, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "mixing")


def realise(docs: DataFrame, mixture: DataFrame, seed: int = 0, blocks: int = 16) -> DataFrame:
    """``docs(doc_id, source, ...)`` with each row as often as the plan passes over it, and columns pass and block.

    Rows are neither shuffled nor gathered: the plan is looked up by source.
    A source's passes, one after another, are cut by place into ``blocks``, so
    that each block has about the planned weights; inside one, order by place
    is the pass's permutation. Rows with the same doc_id and source stand at
    the same place and go together, and so do those without a doc_id. A null
    text, like any without words, has no tokens and is there in every whole
    pass; texts of any length count whole. Columns pass and block are replaced;
    an empty table gives no row.
    """
    docs = docs.drop("pass", "block")
    plan = mixture.select(F.col("source").alias("__source"), "whole", "last_place")
    known = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    rows = docs.join(known.withColumnsRenamed({"whole": "__whole", "last_place": "__last"}), F.col("source").eqNullSafe(F.col("__source")), "left")
    one_more = F.coalesce((place(seed, F.col("__whole")) <= F.col("__last")).cast("int"), F.lit(0))
    rows = rows.withColumn("__n", (F.col("__whole") + one_more).cast("int")).filter("__n > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    length = F.col("__whole") + F.coalesce(F.col("__last") / F.lit(float(1 << PLACE_BITS)), F.lit(0.0))
    at = (F.col("pass") + place(seed, F.col("pass")) / F.lit(float(1 << PLACE_BITS))) / length
    return rows.withColumn("block", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("int")).drop("__source", "__whole", "__last", "__n")


#: What the pipeline and the query ask for.
TARGET, SEED, BLOCKS = Target("repetition", 1.5), 7, 16


def op8_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as often as the mixture holds it, with its pass and block."""
    counts = token_counts(table(spark, sf_dir, "documents"))
    return realise(counts, plan(counts, TARGET, seed=SEED), SEED, BLOCKS).select("doc_id", "source", "n_tokens", "pass", "block")


def _sql_place(number: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || {number} || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT"


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
q AS (SELECT source, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM t) AS q FROM t WHERE tokens > 0),
g AS (SELECT g, max(pow(q, g / {GRID}) / tokens) / min(pow(q, g / {GRID}) / tokens) AS repeats FROM q, range(0, {GRID + 1}) AS r(g) GROUP BY g),
a AS (SELECT coalesce(min(g), {GRID}) / {GRID} AS a FROM g WHERE repeats <= {TARGET.value} + 1e-9),
p AS (SELECT t.source, t.tokens, CASE WHEN t.tokens > 0 THEN round(pow(q, a) / t.tokens / (SELECT min(pow(q, a) / tokens) FROM q, a), 9) ELSE 1.0 END AS passes
      FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source, a),
s AS (SELECT source, floor(passes)::BIGINT AS whole, floor((passes - floor(passes)) * tokens)::BIGINT AS rest FROM p),
l AS (SELECT d.source, rest, n_tokens, {_sql_place("whole")} AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE n_tokens > 0 AND rest > 0),
c AS (SELECT source, rest, place, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM l),
m AS (SELECT source, max(place) AS last_place FROM c WHERE so_far < rest GROUP BY source),
r AS (SELECT d.*, whole, last_place, whole + coalesce(({_sql_place("whole")} <= last_place)::BIGINT, 0) AS n
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
e AS (SELECT *, unnest(range(0, n)) AS pass FROM r)
SELECT doc_id, source, n_tokens, pass::INTEGER AS pass,
       least(floor((pass + {_sql_place("pass")} / {float(1 << PLACE_BITS)}) / (whole + coalesce(last_place / {float(1 << PLACE_BITS)}, 0.0)) * {BLOCKS}), {BLOCKS - 1})::INTEGER AS block
FROM e
"""
