"""From nested filing documents to the long fact panel.

A document is ``facts: {namespace: {tag: {units: {unit: [record]}}}}``. It is parsed once, either with a
schema of maps, which builds every tag, or as a VARIANT, of which only the paths of wanted tags are
built; then it is exploded to one row a record, and joined to a small table of tag chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import foreign_unit
from ..shared import checked, written

RECORD = "struct<start:string,end:string,val:string,accn:string,fy:int,fp:string,form:string,filed:string>"
SCHEMA = f"struct<facts:map<string,map<string,struct<units:map<string,array<{RECORD}>>>>>>"
#: A smaller count of shares is a placeholder.
LEAST_SHARES = 1_000_000

# The tags of each concept, first choice first, and the unit.
CHAINS = {
    "revenues": ("us-gaap", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"), "USD"),
    "gross_profit": ("us-gaap", ("GrossProfit",), "USD"),
    "operating_income": ("us-gaap", ("OperatingIncomeLoss",), "USD"),
    "net_income": ("us-gaap", ("NetIncomeLoss",), "USD"),
    "stockholders_equity": ("us-gaap", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), "USD"),
    "total_assets": ("us-gaap", ("Assets",), "USD"),
    "current_liabilities": ("us-gaap", ("LiabilitiesCurrent",), "USD"),
    "cash_and_equivalents": ("us-gaap", ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"), "USD"),
    "depreciation_amortization": ("us-gaap", ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "Depreciation"), "USD"),
    "operating_cash_flow": ("us-gaap", ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"), "USD"),
    "capex": ("us-gaap", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"), "USD"),
    "buybacks": ("us-gaap", ("PaymentsForRepurchaseOfCommonStock",), "USD"),
    "dividends_paid": ("us-gaap", ("PaymentsOfDividendsCommonStock", "PaymentsOfDividends"), "USD"),
}
SHARES = (("dei", "EntityCommonStockSharesOutstanding"), ("us-gaap", "CommonStockSharesOutstanding"))
# The tags of share counts above, and of debt.
DEBT_PAIR, DEBT_FALLBACK = ("LongTermDebtNoncurrent", "LongTermDebtCurrent"), ("LongTermDebt", "DebtLongtermAndShorttermCombinedAmount")


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``doc``; NULL where the text is no such document."""
    return docs.withColumn("doc", F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}))


def records_at(doc: Column, namespace: str, tag: str, unit: str) -> Column:
    """The records under one path; NULL if there is none."""
    return F.try_element_at(F.try_element_at(F.try_element_at(doc["facts"], F.lit(namespace)), F.lit(tag))["units"], F.lit(unit))


#: Every tag that a chain, the share counts or the debt sum names.
WANTED = tuple(sorted({t for _, tags, _ in CHAINS.values() for t in tags} | {t for _, t in SHARES} | {*DEBT_PAIR, *DEBT_FALLBACK}))


def records(docs: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """``cik, namespace, tag, unit, pos`` and the record's fields, one row a record.

    With ``tags`` the others leave inside the document, before anything is exploded.
    """
    kept = F.col("tags") if tags is None else F.map_filter("tags", lambda t, _: t.isin(*tags))
    a = docs.select("cik", F.explode("doc.facts").alias("namespace", "tags"))
    b = a.select("cik", "namespace", F.explode(kept).alias("tag", "body"))
    c = b.select("cik", "namespace", "tag", F.explode("body.units").alias("unit", "items"))
    return _typed(c)


def _typed(units: DataFrame) -> DataFrame:
    """One row a record of ``cik, namespace, tag, unit, items``."""
    d = units.select("cik", "namespace", "tag", "unit", F.posexplode("items").alias("pos", "r"))
    number = F.col("r.val").try_cast("double")
    return d.select("cik", "namespace", "tag", "unit", "pos", F.col("r.start").try_cast("date").alias("period_start"), F.col("r.end").try_cast("date").alias("period_end"), F.col("r.filed").try_cast("date").alias("filed"), "r.accn", "r.form", F.col("r.fy").cast("double").alias("fy"), "r.fp", number.alias("value"))


#: Where those tags are.
PATHS = tuple(dict.fromkeys([(ns, t) for ns, tags, _ in CHAINS.values() for t in tags] + [*SHARES] + [("us-gaap", t) for t in (*DEBT_PAIR, *DEBT_FALLBACK)]))
NAMESPACES = ("us-gaap", "dei")
SHARE_UNIT, DEBT_UNIT = "shares", "USD"


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``doc``, a VARIANT; NULL where the text is no JSON (a key twice in an object, too) or beyond a VARIANT's size."""
    return docs.withColumn("doc", F.try_parse_json(text))


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _read(doc: Column, paths: tuple = PATHS) -> Column:
    """An array of ``namespace, tag, units``: the units' records under each path, NULL where it leads nowhere."""
    kind = f"map<string,array<{RECORD}>>"
    return F.array(*[F.struct(F.lit(ns).alias("namespace"), F.lit(t).alias("tag"), F.try_variant_get(doc, _path("facts", ns, t, "units"), kind).alias("units")) for ns, t in paths])


def _spread(read: DataFrame) -> DataFrame:
    # outer, though the array is never empty: else a filter on its size is put before it, which parses a document for each path
    a = read.select("cik", F.explode_outer("read").alias("x")).select("cik", "x.namespace", "x.tag", F.explode("x.units").alias("unit", "items"))
    return _typed(a)


def records_on_paths(docs: DataFrame, paths: tuple = PATHS) -> DataFrame:
    """As ``records``, of VARIANT documents and the ``(namespace, tag)`` of ``paths`` alone.

    Nothing else of a document is built. Missing and mistyped parts of it give no rows.
    """
    return _spread(docs.select("cik", _read(F.col("doc"), paths).alias("read")))


def foreign_records(doc: Column) -> Column:
    """How many records of a VARIANT document are in other currencies than USD; records are counted, not built."""
    kind = "map<string,struct<units:map<string,array<variant>>>>"
    none = F.array().cast("array<struct<key:string,value:array<variant>>>")
    total = F.lit(0).cast("long")
    for ns in NAMESPACES:
        bodies = F.map_values(F.try_variant_get(doc, _path("facts", ns), kind))
        units = F.flatten(F.transform(bodies, lambda b: F.coalesce(F.map_entries(b["units"]), none)))
        n = F.aggregate(units, F.lit(0).cast("long"), lambda n, u: n + F.when(foreign_unit(u["key"]) & u["value"].isNotNull(), F.size(u["value"])).otherwise(0))
        total += F.coalesce(n, F.lit(0).cast("long"))
    return total


def _usable(r: Column) -> Column:
    return r["end"].try_cast("date").isNotNull() & r["filed"].try_cast("date").isNotNull() & r["val"].try_cast("double").isNotNull()


def _presence() -> dict[str, Column]:
    """Whether a document's ``read`` has a record for each concept, and its number of placeholders of share counts."""

    def items(ns: str, tag: str, unit: str) -> Column:
        every = F.try_element_at(F.col("read")[PATHS.index((ns, tag))]["units"], F.lit(unit))
        return F.filter(F.coalesce(every, F.array().cast(f"array<{RECORD}>")), _usable)

    def any_of(columns: list[Column]) -> Column:
        return F.size(F.flatten(F.array(*columns))) > 0

    small = lambda r: r["val"].try_cast("double") < LEAST_SHARES
    counts = F.flatten(F.array(*[items(ns, t, SHARE_UNIT) for ns, t in SHARES]))
    key = lambda r: F.struct(r["end"].try_cast("date").alias("e"), r["filed"].try_cast("date").alias("f"), r["accn"].alias("a"))
    far, near = [F.transform(items("us-gaap", t, DEBT_UNIT), key) for t in DEBT_PAIR]
    out = {c: any_of([items(ns, t, unit) for t in tags]) for c, (ns, tags, unit) in CHAINS.items()}
    out["shares_outstanding"] = F.exists(counts, lambda r: ~small(r))
    out["total_debt"] = F.arrays_overlap(far, near) | any_of([items("us-gaap", t, DEBT_UNIT) for t in DEBT_FALLBACK])
    # a placeholder of a key that a record before it has filled is no loss
    same = lambda x, r: x["start"].eqNullSafe(r["start"]) & (x["end"] == r["end"]) & (x["filed"] == r["filed"])
    lost = F.filter(counts, lambda r, i: small(r) & ~F.exists(F.slice(counts, F.lit(1), i), lambda x: ~small(x) & same(x, r)))
    return out | {"placeholders": F.size(lost)}


def chain_table(spark: SparkSession, chains: dict = CHAINS) -> DataFrame:
    """``concept, namespace, tag, unit, priority``: a fixed handful of rows."""
    rows = [(c, ns, t, unit, i) for c, (ns, tags, unit) in chains.items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, namespace string, tag string, unit string, priority int")


def complete(rows: DataFrame) -> DataFrame:
    return rows.where("period_end IS NOT NULL AND filed IS NOT NULL AND value IS NOT NULL")


def first_tag_wins(rows: DataFrame) -> DataFrame:
    """One row for each ``cik, concept, period_start, period_end, filed``: first tag, then first record."""
    w = Window.partitionBy("cik", "concept", "period_start", "period_end", "filed").orderBy("priority", "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_populated_tag(rows: DataFrame) -> DataFrame:
    """The rows of each company's and concept's first tag that has any."""
    w = Window.partitionBy("cik", "concept")
    return rows.withColumn("_p", F.min("priority").over(w)).where("priority = _p").drop("_p")


def chained(every: DataFrame, chains: dict = CHAINS) -> DataFrame:
    """The rows of all chains, united, first tag first."""
    table = chain_table(every.sparkSession, chains)
    return first_tag_wins(complete(every).join(F.broadcast(table), ["namespace", "tag", "unit"]))


def shares(every: DataFrame) -> DataFrame:
    """Share counts of both namespaces; placeholders go before they could hold a key."""
    priority = F.coalesce(*[F.when((F.col("namespace") == ns) & (F.col("tag") == t), i) for i, (ns, t) in enumerate(SHARES)])
    rows = complete(every).where("unit = 'shares'").withColumns({"priority": priority, "concept": F.lit("shares_outstanding")})
    return first_tag_wins(rows.where((F.col("priority").isNotNull()) & (F.col("value") >= LEAST_SHARES)))


def total_debt(every: DataFrame) -> DataFrame:
    """Long-term debt as the sum of its two legs of one filing; where there is none, from whole tags.

    Legs meet on period end, filing date and accession number (NULL equals NULL); the first current
    leg of a key counts. Whole tags (the first that a company uses) give the period ends and filing
    dates that no pair gave.
    """
    usd = complete(every).where("namespace = 'us-gaap' AND unit = 'USD'")
    columns = ["cik", "period_start", "period_end", "filed", "form", "fy", "fp", "value"]
    key = ["cik", "period_end", "filed", "accn"]
    w = Window.partitionBy(*key).orderBy("pos")
    far = usd.where(F.col("tag") == DEBT_PAIR[0])
    near = usd.where(F.col("tag") == DEBT_PAIR[1]).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("value").alias("near"))
    same = (F.col("cik") == F.col("k_cik")) & (F.col("period_end") == F.col("k_period_end")) & (F.col("filed") == F.col("k_filed")) & F.col("accn").eqNullSafe(F.col("k_accn"))
    pair = far.join(near, same).withColumns({"value": F.col("value") + F.col("near"), "period_start": F.lit(None).cast("date")}).select(*columns)
    rest = usd.where(F.col("tag").isin(*DEBT_FALLBACK)).withColumns({"priority": F.when(F.col("tag") == DEBT_FALLBACK[0], 0).otherwise(1), "concept": F.lit("total_debt")})
    rest = first_populated_tag(rest).join(pair.select("cik", "period_end", "filed"), ["cik", "period_end", "filed"], "left_anti").select(*columns)
    return pair.unionByName(rest)


def foreign_units(docs: DataFrame) -> DataFrame:
    """``cik, foreign_facts``: records in other currencies than USD."""
    a = docs.select("cik", F.explode("doc.facts").alias("namespace", "tags")).where(F.col("namespace").isin(*NAMESPACES)).select("cik", F.explode("tags").alias("tag", "body")).select("cik", F.explode("body.units").alias("unit", "items"))
    return a.groupBy("cik").agg(F.sum(F.when(foreign_unit(F.col("unit")), F.size("items")).otherwise(0)).cast("long").alias("foreign_facts"))


COLUMNS = ("cik", "concept", "unit", "period_start", "period_end", "filed", "form", "fy", "fp", "value")


def _united(every: DataFrame, universe: DataFrame) -> DataFrame:
    parts = [chained(every).select(*COLUMNS), shares(every).select(*COLUMNS), total_debt(every).withColumns({"concept": F.lit("total_debt"), "unit": F.lit(DEBT_UNIT)}).select(*COLUMNS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(checked(universe.select("ticker", "cik")), "cik").select("ticker", *COLUMNS)


def panel(docs: DataFrame, universe: DataFrame) -> DataFrame:
    """The 11-column fact panel; a company with several tickers gives its facts to each of them."""
    return _united(written(records(docs, WANTED), "records"), universe)  # three branches read it; a document is parsed once


def counted_panel(docs: DataFrame, universe: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The panel of VARIANT documents, and what the pass that parses them met.

    ``malformed`` and ``foreign`` count documents and records of the universe's companies; ``seen``,
    ``placeholders`` and ``missing <concept>`` count a company once for each of its tickers. Documents of
    other companies are left unread. The counts are observed by the job that writes the records, in its last
    stage, so no document is read for them again and a repeated task counts once.
    """
    tickers = universe.where("cik IS NOT NULL").groupBy("cik").agg(F.count("*").alias("tickers"))
    kept = docs.join(checked(tickers), "cik").withColumn("read", _read(F.col("doc")))
    has = _presence()
    well, n = F.col("doc").isNotNull(), F.col("tickers")
    each = {"malformed": F.when(~well, 1), "seen": F.when(well, n), "foreign": F.when(well, foreign_records(F.col("doc"))), "placeholders": F.when(well, n * has.pop("placeholders"))}
    each |= {f"missing {c}": F.when(well & ~x, n) for c, x in has.items()}
    # columns before they are observed: every task sends the observed expressions to the driver with its sums
    counted = kept.select("cik", "read", *[x.cast("long").alias(f"_{k}") for k, x in each.items()])
    total = lambda k: F.coalesce(F.sum(f"`_{k}`"), F.lit(0).cast("long")).alias(k)
    seen = Observation("panel")
    every = written(_spread(counted.observe(seen, *map(total, each))), "records")
    return _united(every, universe), dict(seen.get)
