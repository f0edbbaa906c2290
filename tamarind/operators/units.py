"""Problem 6: claims and prices in common units."""

from __future__ import annotations

import json
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarind.functions import quantity as q
from tamarind.functions.frames import frame
from tamarind.session import table

SIZE_FIELDS = {"AREA": ("DM2", q.AREA, 100), "FRONTAGE": ("CM", q.LENGTH, 100), "DEPTH": ("CM", q.LENGTH, 100)}
BASIS_UNITS = {"PER_SQM": q.SQM, "PER_MONTH": q.MONTH, "PER_YEAR": q.YEAR, "PER_RAI": q.RAI, "PER_HECTARE": q.HECTARE, "PER_SQWA": q.SQWA}
BIGINT = 2**63 - 1

_parse = lru_cache(maxsize=65536)(q.parse)


def convert_size(field: str, text: str | None) -> tuple[str, int | None]:
    """Unit and whole amount of an AREA, FRONTAGE or DEPTH text; the amount is None where nothing parses."""
    unit, dims, per_base = SIZE_FIELDS[field]
    got = _parse(text, dims)
    return unit, None if got is None else q.half_even(got.value * per_base)


def convert_price(text, amount, currency, basis, rates) -> tuple[str, int | None]:
    """Unit and whole kip of a price: the text holds, the observation fills what the text leaves out.

    ``rates`` maps a currency to kip per unit.  Where the text states no scale word and the
    observed amount is its number times a power of ten of at least 1 000, the scale was left out
    of the text and is the observation's.
    """
    got = _parse(text, q.MONEY)
    observed = None if amount is None else Fraction(amount)
    value = got.value if got else observed
    if got and not got.scaled and observed and got.value and got.value < 1_000_000:
        ratio = observed / got.value
        if ratio.denominator == 1 and ratio.numerator >= 1000 and set(str(ratio.numerator)[1:]) == {"0"} and str(ratio.numerator)[0] == "1":
            value = observed
    money = (got and got.currency) or currency
    per = (got and got.per) or BASIS_UNITS.get(basis)
    unit = "LAK" if per is None else "LAK_PER_MONTH" if per.dims == q.TIME else "LAK_PER_SQM"
    rate = Fraction(1) if money == "LAK" else rates.get(money)
    if value is None or rate is None:
        return unit, None
    return unit, q.half_even(value * rate / (per.scale if per else 1))


@lru_cache(maxsize=65536)
def _rates(text: str | None) -> dict[str, Fraction]:
    return {c: Fraction(r) for c, r in json.loads(text).items()} if text else {}


def common_units(field, text, amount, currency, basis, rates) -> tuple[str | None, int | None]:
    """Dispatch by claim field; unknown fields give (None, None), amounts beyond bigint give None; ``rates`` is JSON."""
    if field == "PRICE":
        unit, value = convert_price(text, amount, currency, basis, _rates(rates))
    elif field in SIZE_FIELDS:
        unit, value = convert_size(field, text)
    else:
        return None, None
    return unit, value if value is not None and abs(value) <= BIGINT else None


def _convert_batches(batches):
    for x in batches:
        rows = [common_units(*(None if v is None or v != v else v for v in row)) for row in x[["field", "value_text", "amount", "currency", "basis", "rates"]].itertuples(index=False, name=None)]
        yield frame(claim_id=x["claim_id"].to_numpy(), unit=[r[0] for r in rows], amount=[r[1] for r in rows])


def rates_by_day(fx: DataFrame) -> DataFrame:
    """``(rate_date, rates)``: one row per calendar day with the last rate of every currency on or before it, as JSON.

    ``fx`` is a fixed reference table of days; its size grows with the calendar alone.  Of rows of
    one currency and day the largest source name counts.
    """
    known = fx.where("currency is not null and rate_date is not null and lak_per_unit is not null").groupBy("currency", "rate_date").agg(F.max_by("lak_per_unit", F.coalesce("source", F.lit(""))).alias("rate"))
    days = known.agg(F.min("rate_date").alias("a"), F.max("rate_date").alias("b"), F.collect_set("currency").alias("c"))
    days = days.select(F.explode(F.sequence("a", "b")).alias("rate_date"), "c").select("rate_date", F.explode("c").alias("currency"))
    back = Window.partitionBy("currency").orderBy("rate_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(known, ["currency", "rate_date"], "left").withColumn("rate", F.last("rate", ignorenulls=True).over(back)).where("rate is not null")
    return filled.groupBy("rate_date").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("currency", F.col("rate").cast("string"))))).alias("rates"))


def quantities_in_common_units(claims: DataFrame, prices: DataFrame, fx: DataFrame) -> DataFrame:
    """``(claim_id, unit, amount)`` of every AREA, FRONTAGE, DEPTH claim and PRICE claim with an observation.

    Repeated rows of a claim or observation count once (of differing ones the smallest value text
    and the smallest observation id); null texts give a null amount, or for a price the observed
    amount; foreign money before the first rate gives null.  Columns besides those named are not read.
    """
    one = claims.where(F.col("field").isin(*SIZE_FIELDS, "PRICE") & F.col("claim_id").isNotNull()).groupBy("claim_id").agg(F.min(F.struct("field", "value_text")).alias("c")).select("claim_id", "c.field", "c.value_text")
    day = F.to_date(F.to_utc_timestamp(F.coalesce("post_date", "observed_at"), F.current_timezone()))  # the UTC day in any session
    price = prices.where("claim_id is not null").groupBy("claim_id").agg(F.min(F.struct("price_observation_id", "amount_original", "currency_original", "price_basis", day.alias("day"))).alias("p")).select("claim_id", "p.*")
    rates = rates_by_day(fx)
    last = fx.where("currency is not null and lak_per_unit is not null").agg(F.max("rate_date")).first()[0]  # one date
    # A row a calendar day, whatever the claims: 30 years are some 11 000 rows.
    price = price.withColumn("rate_date", F.least("day", F.lit(last).cast("date"))).join(F.broadcast(rates), "rate_date", "left")
    both = one.join(price, "claim_id", "left").where("field <> 'PRICE' or price_observation_id is not null")
    texts = both.select("claim_id", "field", "value_text", *(F.col(c).cast("string").alias(n) for c, n in (("amount_original", "amount"), ("currency_original", "currency"), ("price_basis", "basis"), ("rates", "rates"))))
    return texts.mapInPandas(_convert_batches, "claim_id long, unit string, amount long")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities_in_common_units(*(table(spark, sf_dir, t) for t in ("claims", "price_observations", "fx_rates")))
