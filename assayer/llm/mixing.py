"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import SALTS

#: Without given weights, a source weighs its share of rows to this power, so that small sources gain.
POWER = 0.5
#: So many rates are broadcast at most; more sources meet their rows by a salted join.
BROADCAST_SOURCES = 4_096
SEED = 17


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts and the same on every machine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdfs(table: DataFrame, key: str, rate: str) -> DataFrame:
    """`__source`, `__cdf`: for each row of a table with one row a key, the distribution function of a Poisson variable of its rate at
    0, 1, ... up to where less than 1e-15 is left. Running sums along k, so the work is about the rate."""
    r, k = F.col(rate), F.col("__k").cast("double")
    last = F.ceil(r + F.sqrt(r) * 10 + 30).cast("int")
    steps = table.select(F.col(key).alias("__source"), r.alias(rate), F.explode(F.sequence(F.lit(0), last)).alias("__k"))
    along = Window.partitionBy("__source").orderBy("__k")  # one source's distribution: about as many rows as its rate
    factorial = F.sum(F.when(k > 0, F.log(k)).otherwise(0.0)).over(along)
    chance = F.when(r > 0, F.exp(k * F.log(r) - r - factorial)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
    summed = steps.withColumn("__p", chance).select("__source", F.struct("__k", F.sum("__p").over(along).alias("p")).alias("__at"))
    return summed.groupBy("__source").agg(F.transform(F.array_sort(F.collect_list("__at")), lambda x: x["p"]).alias("__cdf"))


def rates(docs: DataFrame, weights: dict[str, float] | None, source: str = "source", rows: float = 1.0) -> DataFrame:
    """One row for each source: `__source`, and the mean number of copies of its rows that gives the source its share.

    `rows` is the wanted size of the mixture, as a multiple of the input's."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(POWER))
    else:
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    rate = F.coalesce(F.try_divide(F.col("w"), F.col("tw")) * F.col("tn") * F.lit(float(rows)) / F.col("n"), F.lit(0.0))
    return weighed.crossJoin(F.broadcast(total)).select("__source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", rows: float = 1.0, seed: int = SEED) -> DataFrame:
    """Copies of rows, in a global random order, so that sources take shares near their weights: adds `copy` (from 1) and `shuffle_key`.

    A row's number of copies inverts the Poisson distribution of its source's mean rate at a hash of its id, so it can be 0
    and is the same in every run. Sources that `weights` leaves out weigh 0; null is a source of its own. Null ids hash
    as one id; repeated rows get equal counts. Empty table: empty result. Columns named like the added ones are
    replaced; other columns pass through."""
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = poisson_cdfs(rates(docs, weights, source, rows), "__source", "rate")
    drawn = docs.select(*kept, F.col(source).alias("__mine"), uniform(F.col(doc_id), F.lit(seed)).alias("__u"))
    if table.select("__source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        both = drawn.join(F.broadcast(table), F.col("__mine").eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.withColumn("__part", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
        both = drawn.join(salted, F.col("__mine").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__salt")))
    copies = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    counted = both.select(*kept, copies.alias("__n"))
    exploded = counted.filter(F.col("__n") > 0).select(*kept, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    return exploded.withColumn("shuffle_key", uniform(F.col(doc_id), F.col("copy"), F.lit(seed + 1))).orderBy("shuffle_key")
