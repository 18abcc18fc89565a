"""Column expressions: pure functions from columns to a column, all planned by Catalyst.

Missing is NULL, never 0 and never NaN: ``finite`` makes it so at the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's AS241 coefficients for the normal quantile, lowest power first
# (central numerator and denominator, then those of the tails).
CENTRAL_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRAL_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
TAIL_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
TAIL_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)

# Days of one to four quarters, and the tolerance around each.
HORIZONS = {1: 91, 2: 182, 3: 273, 4: 365}
TOLERANCE = 25

# What is taken out of company names, in this order, wherever it occurs.
NAME_JUNK = ("incorporated", "inc.", "inc", "corporation", "corp.", "corp", "company", "co.", "co", "ltd.", "ltd", "l.p.", "lp", "plc", "holdings", "holding", "group", "the ", " the", "class a", "class b", "class c", "class d", "'a'", "'b'", "'c'")


def finite(c: Column) -> Column:
    """``c`` as a double, NULL where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(c: Column) -> Column:
    """A text as a finite double; NULL where it is none."""
    return finite(c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def inverse_yield(c: Column) -> Column:
    """``1 / c``: a cheap multiple is a high yield and a negative one sorts last; 0 is NULL."""
    return ratio(F.lit(1.0), c)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def norm_ppf(p: Column) -> Column:
    """The standard normal quantile for 1e-11 < p < 1 - 1e-11."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.ln(F.when(q <= 0, p).otherwise(1 - p))) - 1.6
    tail = _horner(TAIL_C, t) / _horner(TAIL_D, t)
    return F.when(F.abs(q) <= 0.425, q * _horner(CENTRAL_A, r) / _horner(CENTRAL_B, r)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def week_end(d: Column) -> Column:
    """The Friday on or after ``d``."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def month(d: Column) -> Column:
    return F.trunc(d, "month")


def quarters_spanned(start: Column, end: Column) -> Column:
    """How many quarters a duration covers (1 to 4), NULL if it is near none of them."""
    days = F.datediff(end, start)
    return F.coalesce(*[F.when(F.abs(days - n) <= TOLERANCE, F.lit(k)) for k, n in HORIZONS.items()])


def cik_padded(c: Column) -> Column:
    return F.lpad(F.trim(c), 10, "0")


def cik_bare(c: Column) -> Column:
    return F.trim(c).try_cast("bigint").cast("string")


def vendor_symbol(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("-"))


def ticker_class(c: Column) -> Column:
    """A ticker's canonical form: separators ``. - /`` are one, case and spaces do not count."""
    return F.translate(F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("")), "-/", "..")


def company_name(c: Column) -> Column:
    """A company name without legal forms and punctuation; empty for NULL."""
    bare = reduce(lambda s, junk: F.replace(s, F.lit(junk), F.lit("")), NAME_JUNK, F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def published(c: Column) -> Column:
    """A number as it is published: four decimals, NULL where it is not finite."""
    return F.round(finite(c), 4) + F.lit(0.0)


def verdict(r: Column) -> Column:
    """Banding of a ratio of two figures that should agree."""
    return F.when((r > 5) | (r < 0.2), "RED").when((r > 1.3) | (r < 0.77), "WARN").when(r.isNotNull(), "OK")


def guarded(c: Column, sector: Column, sectors: tuple[str, ...] = ("Financials",)) -> Column:
    """NULL for sectors in which the factor means nothing; a NULL sector keeps its value."""
    return F.when(F.coalesce(sector.isin(*sectors), F.lit(False)), None).otherwise(c)


def data_quality(n_bars: Column, *features: Column) -> Column:
    """Whether a name has a price history (more than one bar), and all features of it."""
    complete = reduce(lambda a, b: a & b, [f.isNotNull() for f in features])
    return F.when(F.coalesce(n_bars, F.lit(0)) <= 1, "missing_prices").when(complete, "ok").otherwise("partial_prices")


def blended(parts: list[tuple[float, Column]], least: float = 0.5) -> Column:
    """The weighted mean of the parts that are there, NULL where less than ``least`` of the weight is."""
    total = sum(w for w, _ in parts)
    have = reduce(lambda a, b: a + b, [F.when(z.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for w, z in parts])
    summed = reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) * F.lit(float(w)) for w, z in parts])
    return F.when((have > 0) & (have / F.lit(float(total)) >= least), summed / have)


def weighted_sum(parts: list[tuple[float, Column]]) -> Column:
    """The sum over the parts that are there; NULL only if none is. Weights are not redistributed."""
    return F.when(F.coalesce(*[z for _, z in parts]).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) * F.lit(float(w)) for w, z in parts]))


def row_mean(*parts: Column) -> Column:
    """The mean of the values that are there."""
    n = reduce(lambda a, b: a + b, [F.when(z.isNotNull(), 1).otherwise(0) for z in parts])
    return ratio(reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) for z in parts]), n.cast("double"))


def foreign_unit(c: Column) -> Column:
    """A three-letter currency code other than USD."""
    return c.rlike("^[A-Za-z]{3}$") & ~c.isin("USD")


def shown(c: Column, form: str) -> Column:
    """A number as a text in a report; ``n/a`` where it is missing."""
    return F.coalesce(F.when(c.isNotNull(), F.format_string(form, c)), F.lit("n/a"))
