"""Record linkage with comparisons and blocking rules of the user's choice.

A comparison grades a pair on one or more columns, from its best level down to 0, and gives -1 (no evidence either way) where
a side is null. Pairs of all rules are built once each; a row of levels is a *pattern*, and pairs are counted by
pattern before anything leaves the executors. Training sees patterns alone: their number is bounded by
the product of the levels and the rules, whatever the tables hold. Expectation-maximisation runs once for each rule, over
its pairs, on all comparisons that the rule does not decide; a comparison trained under several rules takes the mean.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import jaro_winkler_similarity
from graphloom.operators.linkage import TINY, blocking_pairs, bucketed, counted, pair_count
from graphloom.plans.skew import spread_pairs
from graphloom.sources.tables import require_columns

#: From the columns of a side (by name) to the conditions of the levels, best first.
Levels = Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Column]]


@dataclass(frozen=True)
class Comparison:
    name: str
    columns: tuple[str, ...]
    levels: int  # without the null level
    conditions: Levels

    def gamma(self) -> Column:
        """The level of a pair frame with columns ``<c>_l`` and ``<c>_r``."""
        left, right = (lambda c: F.col(f"{c}_l")), (lambda c: F.col(f"{c}_r"))
        missing = F.lit(False)
        for c in self.columns:
            missing = missing | left(c).isNull() | right(c).isNull()
        out = F.when(missing, F.lit(-1))
        for k, condition in enumerate(self.conditions(left, right)):
            out = out.when(condition, F.lit(self.levels - 1 - k))
        return out.otherwise(F.lit(0)).alias(f"gamma_{self.name}")


def equality(name: str, *columns: str) -> Comparison:
    """Two levels: all columns equal, or not."""

    def conditions(l, r):
        same = F.lit(True)
        for c in columns:
            same = same & (l(c) == r(c))
        return [same]

    return Comparison(name, columns, 2, conditions)


def similarity(name: str, column: str, thresholds: Sequence[float] = (0.9, 0.8)) -> Comparison:
    """Equal texts, then Jaro-Winkler similarity at or above each threshold, then anything else."""
    ordered = sorted(thresholds, reverse=True)

    def conditions(l, r):
        score = jaro_winkler_similarity(l(column), r(column), ordered[-1] if ordered else 0.0)
        return [l(column) == r(column), *[score >= F.lit(float(t)) for t in ordered]]

    return Comparison(name, (column,), len(ordered) + 2, conditions)


def closeness(name: str, column: str, distances: Sequence[float], days: bool = False) -> Comparison:
    """Numbers, or with ``days`` dates, at most each distance apart (0 for equality), then anything else."""
    ordered = sorted(distances)

    def conditions(l, r):
        gap = F.abs(F.datediff(l(column), r(column))) if days else F.abs(l(column).cast("double") - r(column).cast("double"))
        return [gap <= F.lit(d) for d in ordered]

    return Comparison(name, (column,), len(ordered) + 1, conditions)


@dataclass(frozen=True)
class Settings:
    comparisons: tuple[Comparison, ...]
    rules: tuple[tuple[str, ...], ...]  # each a list of columns that must be equal
    id_column: str = "unique_id"
    prior: float = 1e-4
    m_top: float = 0.95
    pairs_per_record: int = 300
    match_probability: float = 0.85
    tolerance: float = 1e-4
    max_iterations: int = 25
    seed: int = 42

    @property
    def evidence(self) -> list[str]:
        """Columns that rules and comparisons read."""
        return list(dict.fromkeys([*[c for rule in self.rules for c in rule], *[c for k in self.comparisons for c in k.columns]]))

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.id_column, *self.evidence]))

    @property
    def gammas(self) -> list[str]:
        return [f"gamma_{c.name}" for c in self.comparisons]

    def decided(self, rule: Sequence[str]) -> list[Comparison]:
        """Comparisons whose level a rule fixes, as it asks their columns to be equal."""
        return [c for c in self.comparisons if set(c.columns) <= set(rule)]


Pattern = dict[str, int]


def compared(pairs: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` with a level for each comparison."""
    return pairs.select("*", *[c.gamma() for c in settings.comparisons])


def candidate_pairs(left: DataFrame, right: DataFrame, settings: Settings, alike_once: bool = False) -> DataFrame:
    """Pairs of any rule, each once, with their levels and, for each rule k, ``hit_k``.

    With ``alike_once`` records without their ids: those that agree in all that is compared are one row, with their number
    ``_n_l`` and ``_n_r``. This is enough for :func:`pattern_table`.
    """
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        require_columns(df, settings.columns, f"the {name} table")
        sides.append(counted(df, settings.evidence) if alike_once else df.select(*settings.columns))
    pairs = compared(blocking_pairs(*sides, rules=[list(r) for r in settings.rules]), settings)
    hits = {}
    for k, rule in enumerate(settings.rules):
        hit = F.lit(True)
        for c in rule:
            hit = hit & (F.col(f"{c}_l") == F.col(f"{c}_r"))
        hits[f"hit_{k}"] = F.coalesce(hit, F.lit(False))
    return pairs.withColumns(hits)


def pattern_table(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs by pattern and by the rules that they satisfy; counted in each task before the shuffle."""
    keys = [*settings.gammas, *[f"hit_{k}" for k in range(len(settings.rules))]]
    return pairs.groupBy(*keys).agg(pair_count(pairs))


def random_levels(left: DataFrame, right: DataFrame, settings: Settings) -> dict[str, dict[int, float]]:
    """u: the share of each level among random cross pairs that have both values. All records take part."""
    n_l, n_r = left.count(), right.count()
    sides = []
    for df, s in ((left, "l"), (right, "r")):
        keyed = bucketed(df.select(*settings.columns), settings.id_column, n_l, n_r, settings.pairs_per_record, settings.seed)
        sides.append(keyed.select("_bucket", *[F.col(c).alias(f"{c}_{s}") for c in settings.columns]))
    # as many pairs as meet in even buckets
    sides = spread_pairs(*sides, ["_bucket"], min(n_l, n_r) * settings.pairs_per_record)
    drawn = compared(sides[0].join(sides[1], "_bucket"), settings)
    rows = drawn.groupBy(*settings.gammas).agg(F.count(F.lit(1)).alias("pairs")).collect()
    out = {}
    for c in settings.comparisons:
        counts = {k: 0 for k in range(c.levels)}
        for r in rows:
            if r[f"gamma_{c.name}"] >= 0:
                counts[r[f"gamma_{c.name}"]] += r["pairs"]
        total = sum(counts.values())
        out[c.name] = {k: _clamp(n / total) if total else 1.0 / c.levels for k, n in counts.items()}
    return out


def _clamp(x: float) -> float:
    return min(max(x, TINY), 1.0 - TINY)


def train_rule(
    patterns: Sequence[tuple[Pattern, float]], free: Sequence[Comparison], u: Mapping[str, Mapping[int, float]],
    m: Mapping[str, Mapping[int, float]], prior: float, settings: Settings,
) -> tuple[dict[str, dict[int, float]], float, int]:
    """m of the free comparisons and the share of matches from counts by pattern; a null level has no say."""
    m = {c.name: dict(m[c.name]) for c in free}
    total, step = sum(n for _, n in patterns), 0
    if not total:
        return m, prior, 0
    for step in range(1, settings.max_iterations + 1):
        matched: dict[str, dict[int, float]] = {c.name: {k: 0.0 for k in range(c.levels)} for c in free}
        mass = 0.0
        for pattern, n in patterns:
            yes, no = prior, 1.0 - prior
            for c in free:
                if pattern[c.name] >= 0:
                    yes *= m[c.name][pattern[c.name]]
                    no *= u[c.name][pattern[c.name]]
            share = n * yes / (yes + no)
            mass += share
            for c in free:
                if pattern[c.name] >= 0:
                    matched[c.name][pattern[c.name]] += share
        new = {}
        for c in free:
            seen = sum(matched[c.name].values())
            new[c.name] = {k: _clamp(v / seen) for k, v in matched[c.name].items()} if seen else m[c.name]
        change = max([abs(_clamp(mass / total) - prior), *[abs(new[c.name][k] - m[c.name][k]) for c in free for k in new[c.name]]])
        m, prior = new, _clamp(mass / total)
        if change < settings.tolerance:
            break
    return m, prior, step


@dataclass(frozen=True)
class Model:
    settings: Settings
    m: Mapping[str, Mapping[int, float]]
    u: Mapping[str, Mapping[int, float]]
    runs: Sequence[tuple[int, int, float]]  # rule, iterations, share of matches among its pairs

    def weight(self) -> Column:
        """The match weight of a row of levels, in bits."""
        out = F.lit(math.log2(self.settings.prior / (1.0 - self.settings.prior)))
        for c in self.settings.comparisons:
            bits = F.lit(0.0)
            for k in range(c.levels):
                bits = F.when(F.col(f"gamma_{c.name}") == k, F.lit(math.log2(self.m[c.name][k] / self.u[c.name][k]))).otherwise(bits)
            out = out + bits
        return out


def fit(left: DataFrame, right: DataFrame, settings: Settings) -> tuple[Model, DataFrame]:
    """The model of two tables, and their candidate pairs (not kept: they are built again where they are read)."""
    u = random_levels(left, right, settings)
    pairs = candidate_pairs(left, right, settings)
    rows = pattern_table(candidate_pairs(left, right, settings, alike_once=True), settings).collect()
    start = {
        c.name: {k: settings.m_top if k == c.levels - 1 else (1.0 - settings.m_top) / (c.levels - 1) for k in range(c.levels)}
        for c in settings.comparisons
    }
    trained: dict[str, list[dict[int, float]]] = {}
    runs = []
    for k, rule in enumerate(settings.rules):
        fixed = settings.decided(rule)
        free = [c for c in settings.comparisons if c not in fixed]
        odds = settings.prior / (1.0 - settings.prior)
        for c in fixed:
            odds *= start[c.name][c.levels - 1] / u[c.name][c.levels - 1]
        patterns: dict[tuple[int, ...], float] = {}
        for r in rows:
            if r[f"hit_{k}"]:
                key = tuple(r[f"gamma_{c.name}"] for c in free)
                patterns[key] = patterns.get(key, 0.0) + r["pairs"]
        counted = [(dict(zip([c.name for c in free], key)), n) for key, n in sorted(patterns.items())]
        m, share, steps = train_rule(counted, free, u, start, odds / (1.0 + odds), settings)
        if steps:
            for c in free:
                trained.setdefault(c.name, []).append(m[c.name])
        runs.append((k, steps, share))
    mean = {name: {k: sum(x[k] for x in all_) / len(all_) for k in all_[0]} for name, all_ in trained.items()}
    return Model(settings, {**start, **mean}, u, runs), pairs


def scored(pairs: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """Pairs at or above the threshold of probability, with levels, weight and probability: many to many."""
    s = model.settings
    threshold = s.match_probability if threshold is None else threshold
    weighed = pairs.select(
        F.col(f"{s.id_column}_l").alias("id_l"), F.col(f"{s.id_column}_r").alias("id_r"), *s.gammas, model.weight().alias("match_weight"),
    )
    chance = weighed.withColumn("match_probability", 1.0 / (1.0 + F.pow(F.lit(2.0), -F.col("match_weight"))))
    return chance.where(F.col("match_probability") >= threshold)
