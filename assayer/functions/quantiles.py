"""Exact quantiles of many columns at once, of groups and of what they roll up to, without moving a row.

A first aggregate sketches every column in every group. Sketches say between which two values a wanted rank lies, for a group and for
each group of groups, since their points add up. A second aggregate counts what lies below those values and keeps what lies between
them, a few values in a hundred at most; where that is still much, brackets are narrowed by sketches of what lies inside, first. Only
sketches, counts and the values inside meet, so neither the number of columns nor a hot group adds a shuffle of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.shared import cut

#: Steps of a sketch's grid, its accuracy, values that a bracket may hold when it is read out, and groups that one task may look after.
POINTS, ACCURACY, HELD, GROUPS = 200, 1_000, 50_000, 2_000


def _slack() -> float:
    """Share of all values by which a point's place among them may be off, twice over."""
    return 2 / POINTS + 2 / ACCURACY


def _sketch(value: str) -> str:
    return f"percentile_approx({value}, array({', '.join(f'{i / POINTS!r}D' for i in range(POINTS + 1))}), {ACCURACY})"


class _Targets:
    """Brackets of wanted ranks: for each level a table of keys, column number `c`, share number `s`, number of values `n`, ranks
    `r0` and `r1` between which the quantile lies, and values `lo` and `hi` (null: open) that hold both."""

    def __init__(self, columns: Sequence[str], shares: Sequence[float], keys: Sequence[str], levels: Sequence[int]) -> None:
        self.columns, self.shares, self.keys, self.levels = list(columns), list(shares), list(keys), list(levels)
        self.each = [(c, s) for c in range(len(self.columns)) for s in range(len(self.shares))]
        self.at: dict[int, DataFrame] = {}
        self.small = False

    def value(self, c: int) -> Column:
        return F.col(self.columns[c]).cast("double")

    def together(self, table: DataFrame) -> DataFrame:
        """Few groups: in one task, which needs no shuffle to bring rows of a group together."""
        return table.coalesce(1) if self.small else table

    def side(self, table: DataFrame) -> DataFrame:
        """A table of one row for each group, to be broadcast if groups are few."""
        return F.broadcast(table) if self.small else table

    def _narrow(self, points: DataFrame, by: list[str]) -> DataFrame:
        """New brackets from points `x` of sketches that stand for `n` values each group, of which `off` lie before the first."""
        group = Window.partitionBy(*by)
        weight = F.col("inside") / (POINTS + 1)
        upto = F.sum(weight).over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        first = F.col("place") == 0
        placed = points.withColumns({"__w": weight, "__upto": upto, "__in": F.sum(F.when(first, F.col("inside"))).over(group), "__parts": F.sum(F.when(first, 1)).over(group), "__off": F.sum(F.when(first, F.col("off"))).over(group)})
        off_by = F.col("__in") * _slack() + F.col("__parts")
        low = F.max(F.when(F.col("__off") + F.col("__upto") <= F.col("r0") - off_by, F.col("x")))
        high = F.min(F.when(F.col("__off") + F.col("__upto") - F.col("__w") >= F.col("r1") + 1 + off_by, F.col("x")))
        return placed.groupBy(*by, "n", "r0", "r1", "lo", "hi").agg(low.alias("__lo"), high.alias("__hi")).select(*by, "n", "r0", "r1", F.coalesce("__lo", "lo").alias("lo"), F.coalesce("__hi", "hi").alias("hi"))

    def start(self, sketches: DataFrame) -> int:
        """Brackets from one sketch of each column in each of the finest groups; how many values the largest group may have."""
        most = [(F.max if self.levels == [len(self.keys)] else F.sum)(f"__n{c}") for c in range(len(self.columns))]
        groups, *sizes = sketches.agg(F.count(F.lit(1)), *most).first()
        self.small = groups <= GROUPS
        sketches = self.together(sketches)
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"__n{c}").alias("inside"), F.col(f"__p{c}").alias("p")) for c in range(len(self.columns))])
        long = sketches.select(*self.keys, F.explode(cells).alias("f")).select(*self.keys, "f.*").filter("inside > 0")
        for level in self.levels:
            by = self.keys[:level]
            wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(share)).alias("share")) for s, share in enumerate(self.shares)])
            at = (F.col("n") - 1) * F.col("share")
            ranks = long.groupBy(*by, "c").agg(F.sum("inside").alias("n")).select(*by, "c", "n", F.explode(wanted).alias("w")).select(*by, "c", "n", "w.*").select(*by, "c", "s", "n", F.floor(at).alias("r0"), F.ceil(at).alias("r1"))
            points = long.select(*by, "c", "inside", F.posexplode("p").alias("place", "x")).join(self.side(ranks), [*by, "c"])
            open_end = F.lit(None).cast("double")
            self.at[level] = self._narrow(points.withColumns({"off": F.lit(0), "lo": open_end, "hi": open_end}), [*by, "c", "s"])
        return max((x or 0 for x in sizes), default=0)

    def bracketed(self, df: DataFrame) -> DataFrame:
        """Rows with the columns' values as __v<c> and brackets as __lo_<level>_<c>_<s> and __hi_..."""
        rows = df.select(*self.keys, *[self.value(c).alias(f"__v{c}") for c in range(len(self.columns))])
        for level in self.levels:
            cells = [F.expr(f"max(CASE WHEN c = {c} AND s = {s} THEN {end} END) AS __{end}_{level}_{c}_{s}") for c, s in self.each for end in ("lo", "hi")]
            wide = self.at[level].groupBy(*self.keys[:level]).agg(*cells)
            rows = rows.join(self.side(wide), self.keys[:level], "left") if level else rows.join(F.broadcast(wide), F.lit(True), "left")
        return rows

    def _targets(self) -> list[tuple[int, int, int, str, str, str, str, str]]:
        """Level, column and share of each target, the tag of its columns, and SQL of its value, its bracket's ends, and whether the
        value lies inside."""
        out = []
        for level in self.levels:
            for c, s in self.each:
                tag = f"{level}_{c}_{s}"
                v, lo, hi = f"__v{c}", f"__lo_{tag}", f"__hi_{tag}"
                out.append((level, c, s, tag, v, lo, hi, f"{v} IS NOT NULL AND ({lo} IS NULL OR {v} > {lo}) AND ({hi} IS NULL OR {v} < {hi})"))
        return out

    def _long(self, table: DataFrame, level: int, fields: dict[str, str]) -> DataFrame:
        """A row for each column and share of a level, with columns named in `fields` after the prefixes of the wide ones."""
        cells = [f"struct({c} AS c, {s} AS s, " + ", ".join(f"__{x}_{level}_{c}_{s} AS {n}" for n, x in fields.items()) + ")" for c, s in self.each]
        return table.select(*self.keys[:level], F.expr(f"inline(array({', '.join(cells)}))"))

    def narrow(self, df: DataFrame) -> None:
        """One more round of sketches, of what lies inside each bracket."""
        aggs = []
        for *_, tag, v, lo, _, inside in self._targets():
            aggs += [F.expr(x) for x in (f"count_if({v} <= {lo}) AS __off_{tag}", f"count_if({inside}) AS __in_{tag}", f"{_sketch(f'CASE WHEN {inside} THEN {v} END')} AS __p_{tag}")]
        sketches = self.together(cut(self.bracketed(df).groupBy(*self.keys).agg(*aggs)))
        for level in self.levels:
            by = [*self.keys[:level], "c", "s"]
            long = self._long(sketches, level, {"off": "off", "inside": "in", "p": "p"})
            # a group without a value inside still counts with what lies before
            points = long.select(*by, "off", "inside", F.posexplode_outer("p").alias("place", "x")).withColumn("place", F.coalesce("place", F.lit(0)))
            self.at[level] = cut(self._narrow(points.join(self.side(self.at[level]), by), by))

    def read_out(self, df: DataFrame) -> dict[int, DataFrame]:
        """Keys and, for each column, an array of its quantiles by share; null where a group has no value."""
        aggs = []
        for *_, tag, v, lo, hi, inside in self._targets():
            aggs += [F.expr(x) for x in (f"count_if({v} < {lo}) AS __below_{tag}", f"count_if({v} = {lo}) AS __atlo_{tag}", f"count_if({v} = {hi}) AS __athi_{tag}", f"collect_list(CASE WHEN {inside} THEN {v} END) AS __mid_{tag}")]
        parts = self.together(cut(self.bracketed(df).groupBy(*self.keys).agg(*aggs)))
        return {level: self._picked(parts, level) for level in self.levels}

    def _picked(self, parts: DataFrame, level: int) -> DataFrame:
        by = self.keys[:level]
        long = self._long(parts, level, {x: x for x in ("below", "atlo", "athi", "mid")})
        whole = long.groupBy(*by, "c", "s").agg(F.sum("below").alias("below"), F.sum("atlo").alias("atlo"), F.sum("athi").alias("athi"), F.sort_array(F.flatten(F.collect_list("mid"))).alias("mid"))
        held = whole.join(self.side(self.at[level]), [*by, "c", "s"])

        ranked = lambda rank: F.expr(f"""CASE WHEN {rank} < below THEN raise_error('a rank lies below its bracket')
            WHEN {rank} - below < atlo THEN lo WHEN {rank} - below - atlo < size(mid) THEN get(mid, CAST({rank} - below - atlo AS INT))
            WHEN {rank} - below - atlo - size(mid) < athi THEN hi ELSE raise_error('a rank lies above its bracket') END""")  # noqa: E731
        share = F.array(*[F.lit(float(x)) for x in self.shares])[F.col("s")]
        found = held.withColumns({"__a": ranked("r0"), "__b": ranked("r1")}).withColumn("__q", F.col("__a") + (F.col("__b") - F.col("__a")) * ((F.col("n") - 1) * share - F.col("r0")))
        cells = lambda c: ", ".join(f"max(CASE WHEN c = {c} AND s = {s} THEN __q END)" for s in range(len(self.shares)))
        arrays = [F.expr(f"CASE WHEN max(CASE WHEN c = {c} THEN n END) IS NOT NULL THEN array({cells(c)}) END").alias(name) for c, name in enumerate(self.columns)]
        return found.groupBy(*by).agg(*arrays)


@dataclass
class Quantiles:
    """A table for each level, ready to be joined to rows: broadcast if its groups were counted to be few. `base` has the aggregates
    asked for besides."""

    tables: dict[int, DataFrame]
    base: DataFrame

    def __getitem__(self, level: int) -> DataFrame:
        return self.tables[level]


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], keys: Sequence[str] = (), levels: Sequence[int] | None = None, more: Sequence[Column] = ()) -> Quantiles:
    """Quantiles of each column, interpolated linearly between neighbours, for each group of the first `level` keys, for all levels.

    Gives a table for each level (keys, and an array for each column, by share; a group without any value is missing, a column without
    one is null), and a table of `keys` with the aggregates `more`, which the first reading of `df` yields too. Keys are not null and
    columns hold no NaN. `df` is read twice, and once more for each further power of thirty by which its groups outgrow HELD values."""
    targets = _Targets(columns, shares, keys, levels if levels is not None else [len(keys)])
    first = [x for c in range(len(columns)) for x in (F.count(targets.value(c)).alias(f"__n{c}"), F.expr(_sketch(f"CAST(`{columns[c]}` AS DOUBLE)")).alias(f"__p{c}"))]
    sketches = cut(df.groupBy(*keys).agg(*first, *more))
    inside = targets.start(sketches) * (2 * _slack() + 2 / POINTS)
    while inside > HELD:
        targets.narrow(df)
        inside *= 2 * _slack() + 2 / POINTS
    tables = {level: targets.side(t) for level, t in targets.read_out(df).items()}
    return Quantiles(tables, targets.together(sketches.drop(*[f"__{x}{c}" for x in "np" for c in range(len(columns))])))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The median of a column in each group that has values, as a column of this name."""
    found = exact_quantiles(df, [value], [0.5], keys)
    return found[len(keys)].select(*keys, F.get(value, F.lit(0)).alias(name))
