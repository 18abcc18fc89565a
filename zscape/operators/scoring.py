"""Factor scores: sector-neutral buckets and an equal-contribution composite.

``by`` names the columns of one cross-section (none: the whole table is one). A backtest scores all its
dates at once by putting the date in ``by``. Every row is scored, whatever its ticker; a cross-section may
have any number of names (see ``cross_section``).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blended, inverse_yield
from ..functions.ranks import LEAST_SPREAD
from ..shared import written
from .cross_section import beside, neutral_scores

# The default weights.
WEIGHTS = {
    "composite": {"trend": 0.3334, "quality": 0.3333, "value": 0.3333},
    "subfactors": {
        "trend": {"ret_12_1": 1.0},
        "quality": {"roe": 0.25, "oper_margin_ttm": 0.25, "fcf_margin_ttm": 0.25, "gpa": 0.25},
        "value": {"pe_ratio": 0.3334, "ev_ebitda": 0.3333, "net_payout_yield": 0.3333},
        "risk": {"volatility_26w": 0.3334, "debt_equity": 0.3333, "beta": 0.3333},
    },
}
#: Multiples are scored as yields; of these, less is better.
AS_YIELD, LESS_IS_BETTER = ("pe_ratio", "ev_ebitda"), ("volatility_26w", "debt_equity", "beta")
BUCKETS = ("trend", "quality", "value")
#: Most steps of the equal-contribution iteration, which mostly converges in tens, and the move of a
#: weight below which it ends; whole blocks of steps are passed over once it has.
STEPS, BLOCK, TOLERANCE = 10_000, 50, 1e-10


def signal(df: DataFrame, name: str) -> Column:
    """The raw factor, turned so that higher is better; NULL if the column is absent."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    raw = F.col(name).try_cast("double")
    raw = F.when(~F.isnan(raw), raw)
    return inverse_yield(raw) if name in AS_YIELD else -raw if name in LESS_IS_BETTER else raw


def scored_factors(df: DataFrame, names: list[str], by: list[str], sector: str = "sector") -> DataFrame:
    """``df`` with ``z_<name>``: each signal's Gaussian rank, sector-neutral.

    The rows are dealt out evenly, numbered and written once, so that no task has more of the work below
    because the input has few files. All factors are then scored as rows of one long table that
    carries the number, not the row, and join it by that: rows that share a ticker, or have none, stay rows
    of their own.
    """
    rows = written(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("_id", F.monotonically_increasing_id()), "rows")
    signals = F.explode(F.array(*[F.struct(F.lit(n).alias("_factor"), signal(rows, n).alias("_s")) for n in names]))
    keys = list(dict.fromkeys((*by, sector)))
    long = rows.select("_id", *keys, signals.alias("_x")).select("_id", *keys, "_x.*")
    z = neutral_scores(long, "_s", sector, [*by, "_factor"])
    wide = z.groupBy("_id").agg(*[F.max(F.when(F.col("_factor") == n, F.col("z"))).alias(f"z_{n}") for n in names])
    return rows.join(wide, "_id", "left").select(*df.columns, *[f"z_{n}" for n in names])


def buckets(df: DataFrame, by: list[str], weights: dict = WEIGHTS) -> DataFrame:
    """``df`` with ``<bucket>_score`` (NULL below half of the weight)."""
    subs = weights["subfactors"]
    names = [n for s in subs.values() for n in s]
    out = scored_factors(df, names, by)
    return out.withColumns({f"{b}_score": blended([(w, F.col(f"z_{n}")) for n, w in s.items()]) for b, s in subs.items()}).drop(*(f"z_{n}" for n in names))


def covariances(names: list[str]) -> list[Column]:
    """Sample covariances of each pair, over rows that have both."""
    return [F.covar_samp(a, b).alias(f"{a}*{b}") for a, b in combinations_with_replacement(names, 2)]


def equal_contribution(names: list[str], nominal: dict[str, float] | None, steps: int = STEPS) -> Column:
    """From the columns of ``covariances``: an array of weights whose variance shares are equal.

    A multiplicative fixed point, as a lazy fold over one row; once no weight moves by ``TOLERANCE`` the
    steps that are left keep the state. With ``nominal`` weights, a degenerate
    covariance or a total that is not positive gives those; without, a degenerate covariance gives
    equal weights and a total that is not positive keeps the weights so far.
    """
    k = len(names)
    equal = F.array(*[F.lit(1.0 / k)] * k)
    if nominal is not None:
        whole = sum(nominal.get(n, 0.0) for n in names)
        fallback = F.array(*[F.lit(nominal.get(n, 0.0) / whole if whole > 0 else 1.0 / k) for n in names])
    else:
        fallback = equal
    if k == 1:
        return equal
    s = [[F.col(f"{a}*{b}" if i <= j else f"{b}*{a}") for j, b in enumerate(names)] for i, a in enumerate(names)]
    add = lambda xs: reduce(lambda x, y: x + y, xs)

    def step(state: Column, _: Column) -> Column:
        w = [state["w"][i] for i in range(k)]
        sw = [add([s[i][j] * w[j] for j in range(k)]) for i in range(k)]
        total = add([w[i] * sw[i] for i in range(k)])
        share = [F.greatest(w[i] * sw[i] / total, F.lit(1e-15)) for i in range(k)]
        raised = [w[i] * F.sqrt(F.lit(1.0 / k) / share[i]) for i in range(k)]
        new = F.struct(F.array(*[r / add(raised) for r in raised]).alias("w"), state["w"].alias("before"), F.lit(True).alias("ok"))
        moves = reduce(lambda a, b: a | b, [F.abs(w[i] - state["before"][i]) >= TOLERANCE for i in range(k)])
        stuck = F.struct(state["w"].alias("w"), state["before"].alias("before"), F.lit(False).alias("ok"))
        return F.when(~state["ok"] | ~moves, state).when(total > 0, new).otherwise(stuck)

    first = F.struct(equal.alias("w"), F.array(*[F.lit(-1.0)] * k).alias("before"), F.lit(True).alias("ok"))
    fold = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, step)
    going = lambda state: state["ok"] & reduce(lambda a, b: a | b, [F.abs(state["w"][i] - state["before"][i]) >= TOLERANCE for i in range(k)])
    blocks = F.aggregate(F.sequence(F.lit(1), F.lit(steps // BLOCK)), first, lambda state, _: F.when(going(state), fold(state, BLOCK)).otherwise(state)) if steps >= BLOCK else first
    solved = fold(blocks, steps % BLOCK) if steps % BLOCK else blocks
    usable = reduce(lambda a, b: a & b, [s[i][i] > 0 for i in range(k)] + [s[i][j].isNotNull() & ~F.isnan(s[i][j]) for i in range(k) for j in range(i)])
    result = F.when(solved["ok"], solved["w"]).otherwise(fallback) if nominal is not None else solved["w"]
    return F.when(F.coalesce(usable, F.lit(False)), result).otherwise(fallback)


def build_scores(df: DataFrame, by: list[str] | None = None, weights: dict = WEIGHTS) -> DataFrame:
    """``df`` with the bucket scores and ``composite_score``, all to four decimals.

    Buckets that can't be scored are neutral (0). The composite blends the buckets, each measured
    against the names it scores, by equal-contribution weights of its own cross-section. The buckets
    are computed once and written; one pass then gives each cross-section's means, spreads and
    covariances, from which its weights follow, and a join brings them back.
    """
    by = by or []
    scores = [f"{b}_score" for b in weights["subfactors"]]
    inside = [b for b in BUCKETS if b in weights["composite"]]
    raw = written(buckets(df, by, weights), "buckets")
    filled = {b: F.coalesce(f"{b}_score", F.lit(0.0)) for b in inside}
    pairs = list(combinations_with_replacement(inside, 2))
    moments = [f(f"{b}_score").alias(f"_{n}_{b}") for b in inside for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    facts = raw.groupBy(*by).agg(*moments, *[F.covar_samp(filled[a], filled[b]).alias(f"_c_{a}_{b}") for a, b in pairs])
    spread = {b: F.col(f"_d_{b}") > LEAST_SPREAD for b in inside}  # without it a bucket is 0 for all
    scaled = [F.when(spread[a] & spread[b], F.col(f"_c_{a}_{b}") / (F.col(f"_d_{a}") * F.col(f"_d_{b}"))).otherwise(F.when(F.col(f"_c_{a}_{b}").isNotNull(), 0.0)).alias(f"{a}*{b}") for a, b in pairs]
    solved = facts.select(*by, *(f"_{n}_{b}" for n in "md" for b in inside), *scaled)
    solved = solved.withColumn("_w", equal_contribution(inside, weights["composite"]))
    out = beside(raw, written(solved.drop(*(f"{a}*{b}" for a, b in pairs)), "weights"), by, small=True)
    parts = [F.col("_w")[i] * F.when(spread[b], (filled[b] - F.col(f"_m_{b}")) / F.col(f"_d_{b}")).otherwise(0.0) for i, b in enumerate(inside)]
    out = out.withColumn("composite_score", reduce(lambda a, b: a + b, parts))
    out = out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 4) + F.lit(0.0) for c in [*scores, "composite_score"]})
    return out.drop("_w", *(f"_{n}_{b}" for n in "md" for b in inside))


def best_first(scored: DataFrame, by: list[str] | None = None, key: str = "ticker") -> DataFrame:
    """Scored rows in the order in which they are shown; ties go by ``key``."""
    return scored.orderBy(*(by or []), F.desc("composite_score"), key)
