"""Registered queries: a callable of (session, folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import CENTRAL_A, CENTRAL_B, TAIL_C, TAIL_D
from . import surrogates

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, inputs: str, build: Callable[..., DataFrame], oracle: str | None = None) -> None:
        """``build`` gets the frames of ``inputs`` in their order; ``oracle`` may name the same inputs."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*(surrogates.frame(spark, sf_dir, n) for n in inputs.split()))

        self.queries[name] = run
        if oracle:
            self.oracles[name] = surrogates.sql(inputs, oracle.strip()) if inputs else oracle.strip()


def r6(c: Column | str) -> Column:
    """Rounded for comparison with another engine; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sr6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def avg_rank_sql(v: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    return f"CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY {lead}{v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY {lead}{v}) - 1) / 2e0 END"


def ppf_sql(p: str) -> str:
    def horner(ks, x):
        out = repr(ks[-1])
        for k in reversed(ks[:-1]):
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out.replace(repr(ks[-1]), f"{ks[-1]!r}::DOUBLE", 1)

    q, t = f"({p} - 0.5::DOUBLE)", f"(sqrt(-ln(CASE WHEN {p} <= 0.5 THEN {p} ELSE 1 - {p} END)) - 1.6::DOUBLE)"
    r = f"(0.180625::DOUBLE - {q} * {q})"
    tail = f"({horner(TAIL_C, t)} / {horner(TAIL_D, t)})"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(CENTRAL_A, r)} / {horner(CENTRAL_B, r)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END"


def neutral_sql(z: str, sector: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    all_ = f"PARTITION BY {by}" if by else ""
    own = f"PARTITION BY {lead}{sector}"
    f = lambda fn, w: f"{fn}({z}) OVER ({w})"
    return (
        f"CASE WHEN {f('count', own)} >= 10 AND {f('stddev_pop', own)} > 1e-9 THEN ({z} - {f('avg', own)}) / {f('stddev_pop', own)} "
        f"WHEN {f('stddev_pop', all_)} > 1e-9 THEN ({z} - {f('avg', all_)}) / {f('stddev_pop', all_)} ELSE {z} - {f('avg', own)} END"
    )


def erc_sql(source: str, cols: list[str], steps: int = 300) -> str:
    """The equal-contribution fixed point as a recursive query over one row."""
    k, n = len(cols), range(len(cols))
    cov = ", ".join(f"covar_samp({cols[i]}, {cols[j]}) AS c{i}{j}" for i in n for j in n if i <= j)
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    sw = [" + ".join(f"{c(i, j)} * w{j}" for j in n) for i in n]
    total = " + ".join(f"w{i} * ({sw[i]})" for i in n)
    raised = [f"w{i} * sqrt({1 / k!r}::DOUBLE / greatest(w{i} * ({sw[i]}) / ({total}), 1e-15))" for i in n]
    whole = " + ".join(f"u{i}" for i in n)
    return (
        f"cov AS (SELECT {cov} FROM {source}), step AS (SELECT 0 AS i, {', '.join(f'{1 / k!r}::DOUBLE AS w{i}' for i in n)} "
        f"UNION ALL SELECT i + 1, {', '.join(f'u{i} / ({whole})' for i in n)} FROM (SELECT i, {', '.join(f'{raised[i]} AS u{i}' for i in n)} FROM step, cov WHERE i < {steps})), "
        f"erc AS (SELECT {', '.join(f'w{i}' for i in n)} FROM step WHERE i = {steps})"
    )
