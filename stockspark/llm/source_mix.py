"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a place on a 120-bit line: 60 bits of the md5 of its doc_id and text,
then 60 random bits that are written once and only tell identical rows apart. A
source that is to give ``full + x`` of its words (0 <= x < 1) gives each row ``full``
times, and the rows before a threshold once more. To find the threshold, the words of
a source are summed by the first 12 bits of the place; the bucket in which the sum
passes the budget is summed by its next 12 bits, and so on until it holds one row.
That row is in if the words taken come nearer to the target with it. Rows are never
sorted; each level reads only what its boundary buckets hold, and the result is a
filter by thresholds, one a source.

Places do not depend on budgets, so mixes nest: a smaller budget's rows are among
those of a larger one. All budgets are refined together.

Sources are ranked by code point, null (a source of its own) last; weights repeat
along that order. A source's target is its share by weight, at most ``most`` times
its words; what is above is shared again by weight until none is above.

Null and empty texts have no words and give none; null doc_ids are mixed like others.
Repeated rows are rows like others: of identical rows at a threshold as many are taken
as fit. Sources without words have target 0. An empty table gives an empty mix. Other
columns are ignored, or kept below ``doc`` if asked for.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.llm.common import documents, look_up, save
from stockspark.operators.ordering import global_row_number
from stockspark.session import checkpoint_dir, ship_package

WEIGHTS = (5, 2, 1)
MOST = 3
DIGIT = 12  # bits a level
PLACE = 60  # bits of each half of a place
LEVELS = 2 * PLACE // DIGIT
_WORD = r"[^\x20\x09-\x0D]++"


def digest(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, place, rest, doc): what the mix needs of every row, written once."""
    text = F.coalesce("text", F.lit(""))
    md5 = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return save(docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
        F.conv(F.substring(md5, 1, PLACE // 4), 16, 10).cast("long").alias("place"),
        F.shiftrightunsigned(F.xxhash64(F.rand()), 64 - PLACE).alias("rest"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(None).alias("none")]).alias("doc")), "mix-digest")


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST,
            budgets: Sequence[int | None] = (None,)) -> DataFrame:
    """(source, source_size, budget, target) of a digest; a budget is a number of words, None all words.

    A round shares what is left among the sources below their limit; only its three
    sums reach the driver. It ends when no further source is above its limit.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").isNull(), "source"], "rank")
    listed = F.array(*map(F.lit, weights))
    big = "decimal(38,0)"
    ranked = save(ranked.select("source", "source_size", F.get(listed, ((F.col("rank") - 1) % len(weights)).cast("int")).cast(big).alias("w"),
                                (F.col("source_size") * most).cast(big).alias("top")), "mix-sources")
    words, all_w = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    made = []
    for i, budget in enumerate(budgets):
        left, w, known = int(words if budget is None else budget), int(all_w), 0
        total = left
        while True:
            above = F.col("top") * F.lit(w).cast(big) < F.col("w") * F.lit(left).cast(big)
            n, taken, free = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("top"))), F.lit(0)),
                                        F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
            if n == known:
                break
            left, w, known = total - int(taken), int(free), n
        share = (F.col("w") * F.lit(left).cast(big)).cast("double") / F.lit(float(max(w, 1)))
        made.append(ranked.select("source", "source_size", F.lit(i).alias("budget"),
                                  F.when(above, F.col("top").cast("double")).otherwise(share).alias("target")))
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out


def _prefix(half: str, digits: Column) -> Column:
    """The first ``digits`` digits of one half of a place."""
    return F.call_function("shiftright", F.col(half), (F.lit(PLACE) - digits * DIGIT).cast("int"))


_HALF = PLACE // DIGIT


def _digits() -> tuple[Column, Column]:
    """How many digits of either half a cut holds."""
    return F.least(F.col("level"), F.lit(_HALF)), F.greatest(F.col("level") - _HALF, F.lit(0))


def thresholds(rows: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """``wanted`` with (full, level, c1, c2, need, held): take every row ``full`` times, those before
    the cut (c1, c2: its ``level`` digits) once more, and those on it if ``need`` is nearer to ``held`` than to 0."""
    size = F.col("source_size")
    full = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most))).otherwise(0).cast("long")
    need = F.when((size > 0) & (F.col("full") < most), F.col("target") - F.col("full") * size).otherwise(F.lit(0.0))
    zero = F.lit(0).cast("long")
    cuts = save(wanted.withColumn("full", full).select("*", F.lit(0).alias("level"), zero.alias("c1"), zero.alias("c2"),
                                                       need.alias("need"), size.alias("held"), F.lit(2).cast("long").alias("n")), "mix-cuts")
    names = cuts.columns
    state = [c for c in names if c not in ("held", "n")]
    # a cut is open while its bucket may hold more than one row
    still = (F.col("n") > 1) & (F.col("need") > 0) & (F.col("level") < LEVELS)
    while cuts.where(still).limit(1).count():
        first, second = _digits()
        inside = (look_up(rows.where("size > 0").select("source", "place", "rest", "size"), cuts.where(still).drop("held", "n"),
                          ["source"], ["place", "rest"], "inner")
                  .where((_prefix("place", first) == F.col("c1")) & (_prefix("rest", second) == F.col("c2"))))
        digit = F.when(F.col("level") < _HALF, _prefix("place", first + 1)).otherwise(_prefix("rest", second + 1)) % (1 << DIGIT)
        sums = inside.groupBy(*state, digit.alias("digit")).agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("source", "budget").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        passed = sums.withColumn("upto", F.sum("held").over(run)).where("upto >= need")
        hit = passed.groupBy(*state).agg(F.min_by(F.struct("digit", "held", "n", "upto"), "digit").alias("x"))
        shifted = {c: F.when(on, F.col(c) * (1 << DIGIT) + F.col("x.digit")).otherwise(F.col(c)).alias(c)
                   for c, on in (("c1", F.col("level") < _HALF), ("c2", F.col("level") >= _HALF))}
        new = {"level": F.col("level") + 1, "need": F.col("need") - (F.col("x.upto") - F.col("x.held")),
               "held": F.col("x.held"), "n": F.col("x.n"), **shifted}
        closer = hit.select(*[new.get(c, F.col(c)).alias(c) for c in names])
        cuts = save(cuts.where(~still).unionByName(closer), "mix-cuts")
    return cuts.drop("n")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, budgets: Sequence[int | None] = (None,),
        carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, budget, source_size, target, copies, taken, doc) of every row and budget."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    if not weights or min(weights) < 1 or most < 1 or not budgets:
        raise ValueError("weights and most are at least 1; give at least one budget")
    rows = digest(docs, carry)
    cuts = save(thresholds(rows, targets(rows, weights, most, budgets), most), "mix-thresholds")
    first, second = _digits()
    p, r = _prefix("place", first), _prefix("rest", second)
    on_cut = 2 * F.col("need") >= F.col("held")
    before = (p < F.col("c1")) | ((p == F.col("c1")) & ((r < F.col("c2")) | ((r == F.col("c2")) & on_cut)))
    copies = F.col("full") + ((F.col("need") > 0) & before).cast("long")
    return (look_up(rows, cuts, ["source"], ["place", "rest"]).withColumn("copies", copies)
            .select("doc_id", "source", "size", "budget", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken"), "doc"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """The rows of ``docs`` that make up the mix, each as often as it is taken."""
    made = mix(docs, weights, most, (budget,), docs.columns)
    return made.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_")).select("doc.*")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {PLACE // 4}))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, ({list(WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
      FROM d GROUP BY source),
-- by words per weight: sources above their limit come first
o AS (SELECT *, (SELECT sum(size) FROM s) - coalesce(sum({MOST} * size) OVER (ORDER BY size / w, source NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
             sum(w) OVER (ORDER BY size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
l AS (SELECT rem AS at_rem, ws AS at_ws FROM o WHERE {MOST} * size * ws >= w * rem ORDER BY size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, size AS source_size, CASE WHEN {MOST} * size * at_ws < w * at_rem THEN ({MOST} * size)::DOUBLE
             ELSE (w * at_rem)::DOUBLE / at_ws::DOUBLE END AS target FROM s, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST})::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, CASE WHEN source_size > 0 AND whole < {MOST} THEN target - whole * source_size ELSE 0.0::DOUBLE END AS need FROM f),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN need > 0 AND (upto < need OR (upto - size < need AND 2 * (need - (upto - size)) >= size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
"""
