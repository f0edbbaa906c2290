import datetime as dt
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tamarind.functions import quantity as q
from tamarind.operators.units import convert_price, convert_size, quantities_in_common_units

RATES = {"THB": Fraction(700), "USD": Fraction(20000)}


@pytest.mark.parametrize(
    ("field", "text", "amount"),
    [
        ("AREA", "14 × 34 ມ", 47600), ("AREA", "23 mx10 m", 23000), ("AREA", "47 metresx16 metres", 75200), ("AREA", "461,36 square metres", 46136), ("AREA", "໒,໗໗໐ຕລມ", 277000),
        ("AREA", "5-2-30 ໄຮ່", 892000), ("AREA", "24 rai 3 ngan 35 wa", 3974000), ("AREA", "512 wa", 204800), ("AREA", "40 acres", 16187426), ("AREA", "1,200 ft²", 11148), ("AREA", "9 岸 9 平方哇", 363600),
        ("AREA", "0.6 เฮกตาร์", 600000), ("AREA", "xx", None), ("AREA", "", None), ("AREA", None, None), ("FRONTAGE", "0.08 km", 8000), ("FRONTAGE", "໘໒໐ ຊັງຕີແມັດ", 820), ("DEPTH", "53,5 ແມັດ", 5350),
        ("AREA", "5 feet 3 inches", None), ("AREA", "12 ft 6 in x 30 ft".replace(" in ", " inches "), 3484), ("FRONTAGE", "5 feet 3 inches", 160), ("DEPTH", "2 m 40 cm", 240), ("FRONTAGE", "12 kg", None), ("AREA", "5 zorks", None), ("DEPTH", "36 ວາ", 7200), ("DEPTH", "178 ft", 5425), ("FRONTAGE", "1 700 cm", 1700),
    ],
)
def test_sizes(field, text, amount):
    assert convert_size(field, text)[1] == amount


@pytest.mark.parametrize(
    ("text", "observed", "want"),
    [
        ("672ພັນ ໂດລາ", ("1", "LAK", "TOTAL"), ("LAK", 13_440_000_000)), ("3.050.000 baht", ("3050.00", "THB", "TOTAL"), ("LAK", 2_135_000_000)), ("₭3,300,000 ຕໍ່ຕາແມັດ", (None, None, None), ("LAK_PER_SQM", 3_300_000)),
        ("1.42 tỷ/rai", (None, "LAK", None), ("LAK_PER_SQM", 887_500)), ("9 nghìn USD mỗi năm", (None, None, "TOTAL"), ("LAK_PER_MONTH", 15_000_000)), ("ປີລະ 135 ລ້ານ ກີບ", (None, None, None), ("LAK_PER_MONTH", 11_250_000)),
        ("18 ล้าน 1 แสน บาท", (None, None, None), ("LAK", 12_670_000_000)), ("13200000", ("13200000", "THB", "PER_MONTH"), ("LAK_PER_MONTH", 9_240_000_000)), ("$525 monthly", ("525", "UNKNOWN", None), ("LAK_PER_MONTH", 10_500_000)),
        (None, ("5", "LAK", "UNKNOWN"), ("LAK", 5)), ("5 ກີບ", (None, None, None), ("LAK", 5)), ("5", (None, "EUR", None), ("LAK", None)), ("1,200 EUR", ("1200", "LAK", "TOTAL"), ("LAK", None)), ("£5 per month", (None, "LAK", None), ("LAK_PER_MONTH", None)), ("10 kg rice", (None, "LAK", None), ("LAK", None)), ("900", ("900000.00", "LAK", "PER_SQM"), ("LAK_PER_SQM", 900_000)),
    ],
)
def test_prices(text, observed, want):
    assert convert_price(text, *observed, RATES) == want


@pytest.mark.parametrize(("text", "want", "value"), [("25 °C", q.TEMPERATURE, "298.15"), ("77 °F", q.TEMPERATURE, "298.15"), ("300 kelvin", q.TEMPERATURE, "300"), ("2 tonnes 5 kg", q.MASS, "2005"), ("250 ml 3 litres", q.VOLUME, "0.003"), ("5 kg", q.TEMPERATURE, None)])
def test_other_dimensions_and_offsets(text, want, value):
    got = q.parse(text, want)
    assert (got and got.value) == (None if value is None else Fraction(value))


@given(st.integers(0, 10**12))
def test_grouped_numbers_round_trip(n):
    assert q.parse_number(f"{n:,}") == n
    assert q.parse_number(f"{n:,}".replace(",", " ")) == n


@given(st.integers(1, 999), st.integers(0, 999))
def test_half_even(whole, thousandths):
    value = Fraction(whole) + Fraction(thousandths, 1000)
    assert q.half_even(value) == int(Decimal(whole) + Decimal(thousandths) / 1000 if thousandths == 0 else (Decimal(whole) + Decimal(thousandths) / 1000).to_integral_value("ROUND_HALF_EVEN"))


def test_query_joins_rates_and_drops_copies(spark):
    claims = spark.createDataFrame(
        [(1, "PRICE", "2 USD", "x"), (1, "PRICE", "2 USD", "x"), (2, "AREA", "1 rai", "x"), (3, "PRICE", "3 ກີບ", "x"), (4, "CONTACT", "020", "x"), (None, "AREA", "1 m2", "x"), (5, "DEPTH", None, "x")],
        "claim_id long, field string, value_text string, unit string")
    at = dt.datetime(2024, 1, 5, 12)
    prices = spark.createDataFrame(
        [(9, 1, Decimal("2.00"), "USD", "TOTAL", at, None, "x")], "price_observation_id long, claim_id long, amount_original decimal(20,2), currency_original string, price_basis string, observed_at timestamp, post_date timestamp, amount string")
    fx = spark.createDataFrame([("USD", dt.date(2024, 1, 2), Decimal("20000.5"), "a"), ("USD", dt.date(2024, 1, 7), Decimal("1"), "a"), ("THB", None, None, None)], "currency string, rate_date date, lak_per_unit decimal(18,6), source string")
    got = {tuple(r) for r in quantities_in_common_units(claims, prices, fx).collect()}
    assert got == {(1, "LAK", 40001), (2, "DM2", 160000), (5, "CM", None)}
    assert quantities_in_common_units(claims.limit(0), prices.limit(0), fx.limit(0)).count() == 0


def test_rates_are_those_of_the_utc_day(spark, sf_dir):
    from tamarind.operators.units import p6_found

    want = {tuple(r) for r in p6_found(spark, sf_dir).collect()}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Vientiane")
    try:
        assert {tuple(r) for r in p6_found(spark, sf_dir).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
