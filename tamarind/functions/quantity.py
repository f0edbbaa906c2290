"""Quantities in free text: number and unit grammar over exponent vectors.

A measured value is parsed into a :class:`Quantity`: an exact rational in base
units (metre, month, kip or foreign money, kilogram, kelvin) with an exponent
vector over ``(length, time, money, mass, temperature)``.  Units carry a scale and an offset to
their base unit.  The grammar, over tokens found by longest match:

    quantity := sum [per unit]...           "3 rai 20 wa", "5 lan kip / m2"
    sum      := product product...          terms of falling size are added
    product  := factor [times factor]       "14 x 34 m"
    factor   := NUMBER [SCALE] [unit]       "1.2 million"
    per      := "/" | per-word unit | unit "each"-suffix

All arithmetic is on ``Fraction``; nothing is rounded before the end.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

Dims = tuple[int, int, int, int, int]
LENGTH, TIME, MONEY, MASS, TEMPERATURE = ((0,) * k + (1,) + (0,) * (4 - k) for k in range(5))
AREA, VOLUME = (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    """A unit: exponent vector, scale and offset to the base unit, currency if money."""

    dims: Dims
    scale: Fraction
    offset: Fraction = Fraction(0)
    currency: str | None = None
    either: bool = False  # a length word that also names its square ("wa")


def _u(dims, scale, **more):
    return Unit(dims, Fraction(scale), **more)


METRE, CENTIMETRE, KILOMETRE, FOOT = (_u(LENGTH, s) for s in ("1", "0.01", "1000", "0.3048"))
INCH, YARD, MILLIMETRE = _u(LENGTH, "0.0254"), _u(LENGTH, "0.9144"), _u(LENGTH, "0.001")
WA = _u(LENGTH, "2", either=True)
SQM, SQFT, SQKM, SQCM = _u(AREA, "1"), _u(AREA, "0.09290304"), _u(AREA, "1000000"), _u(AREA, "0.0001")
HECTARE, RAI, NGAN, SQWA, ACRE = (_u(AREA, s) for s in ("10000", "1600", "400", "4", "4046.8564224"))
MONTH, YEAR = _u(TIME, "1"), _u(TIME, "12")
KIP, BAHT, DOLLAR, EURO, POUND, YUAN, DONG, YEN = (_u(MONEY, 1, currency=c) for c in ("LAK", "THB", "USD", "EUR", "GBP", "CNY", "VND", "JPY"))
GRAM, KILOGRAM, TONNE, LITRE = _u(MASS, "0.001"), _u(MASS, "1"), _u(MASS, "1000"), _u(VOLUME, "0.001")
KELVIN, CELSIUS, FAHRENHEIT = _u(TEMPERATURE, "1"), _u(TEMPERATURE, "1", offset=Fraction("273.15")), _u(TEMPERATURE, Fraction(5, 9), offset=Fraction("459.67") * Fraction(5, 9))

# Fixed vocabulary: spellings of each unit, after NFKC, lower case and digit folding.
UNIT_WORDS: dict[Unit, str] = {
    METRE: "m meter meters metre metres mètre mètres mét mét. ມ ແມັດ ແມດ ม เมตร 米",
    CENTIMETRE: "cm centimetre centimetres centimeter centimeters ຊັງຕີແມັດ ຊມ ซม เซนติเมตร เซ็นติเมตร 厘米",
    MILLIMETRE: "mm",
    KILOMETRE: "km kilometre kilometres kilometer kilometers ກິໂລແມັດ ກມ กม กิโลเมตร 公里",
    FOOT: "ft foot feet ຟຸດ ฟุต pied pieds 英尺",
    INCH: "inch inches",
    YARD: "yd yard yards",
    WA: "wa va waa ວາ วา 哇",
    SQM: "m2 m^2 sqm sq.m sq.m. sq_m sq_metre sq_metres sq_meter sq_meters square_metre square_metres square_meter square_meters "
    "ຕາແມັດ ຕາລາງແມັດ ຕລມ ຕມ ຕຣມ ตรม ตารางเมตร ตาราง_เมตร ตร.ม ตร.ม. ຕ.ລ.ມ ຕລ.ມ mètre_carré mètres_carrés mét_vuông 平方米 平米 ta_met talang_met tamet",
    SQFT: "ft2 sqft sq_ft sq.ft square_foot square_feet ຕາຟຸດ ตารางฟุต pied_carré pieds_carrés 平方英尺",
    SQKM: "km2 sqkm sq_km ຕາກິໂລແມັດ ตารางกิโลเมตร",
    SQCM: "cm2",
    HECTARE: "ha hectare hectares ເຮັກຕາ ເຮັກຕ້າ เฮกตาร์ เฮกแตร์ héc-ta hecta 公顷 hekta",
    RAI: "rai rais hai ໄຮ່ ไร่ 莱",
    NGAN: "ngan ngans ງານ งาน 岸",
    SQWA: "sq_wa sqwa sq.wa sq_va sqva square_wa square_wah ta_va talang_va tava ຕາວາ ຕາລາງວາ ຕລວ ຕ.ລ.ວ ตารางวา ตาราง_วา ตรว ตร.ว ตร.ว. 平方哇",
    ACRE: "acre acres ac ເອເຄີ เอเคอร์ 英亩",
    MONTH: "month months mo mth mois tháng deuan duean ເດືອນ เดือน 个月 月 monthly",
    YEAR: "year years yr an ans année pi pee năm ປີ ปี 年 yearly annually",
    KIP: "lak kip kips kíp kip. ₭ ກີບ กีบ 基普",
    BAHT: "thb baht bahts bath bạt ฿ ບາດ บาท 泰铢 铢",
    DOLLAR: "usd us$ $ dollar dollars dola dolla đô_la đô đôla ໂດລາ ໂດລ້າ ໂດລາສະຫະລັດ ดอลลาร์ ดอลล่าร์ ดอลล่า 美元 美金",
    EURO: "eur euro euros € ເອີໂຣ ยูโร 欧元", POUND: "gbp £ 英镑", YUAN: "cny rmb yuan ຢວນ หยวน 人民币", DONG: "vnd ₫ đồng", YEN: "jpy yen ¥ 日元",
    GRAM: "g gram grams gramme grammes 克", KILOGRAM: "kg kgs kilo kilos kilogram kilograms ກິໂລກຣາມ กิโลกรัม กก 公斤", TONNE: "tonne tonnes ton tons ໂຕນ 吨", LITRE: "l litre litres liter liters ລິດ ลิตร 升",
    KELVIN: "kelvin", CELSIUS: "°c celsius ℃ 摄氏度", FAHRENHEIT: "°f fahrenheit ℉",
}
SCALE_WORDS: dict[Fraction, str] = {
    Fraction(1_000): "k thousand phan pan nghìn ngàn mille ພັນ พัน 千",
    Fraction(10_000): "meun muen mun ໝື່ນ ຫມື່ນ หมื่น 万 vạn",
    Fraction(100_000): "sen saen ແສນ แสน",
    Fraction(1_000_000): "million millions mil mio lan laan triệu tr ລ້ານ ล้าน 百万",
    Fraction(100_000_000): "亿",
    Fraction(1_000_000_000): "billion billions bn tue teu ຕື້ milliard milliards tỷ tỉ พันล้าน",
}
PER_WORDS = "/ per par pour tor to ຕໍ່ ต่อ mỗi 每 a"
EACH_WORDS = "ລະ ละ la"
TIMES_WORDS = "x × * ✕ by ຄູນ คูณ"


def fold(text: str) -> str:
    """NFKC, lower case, any script's digits as ASCII, invisible signs as nothing, spaces as one."""
    out = []
    for ch in unicodedata.normalize("NFKC", text).lower():
        kind = unicodedata.category(ch)
        if kind == "Nd":
            out.append(str(unicodedata.digit(ch)))
        elif kind == "Cf":
            continue
        elif kind in ("Zs", "Cc", "Zl", "Zp"):
            out.append(" ")
        else:
            out.append(ch)
    return "".join(out).strip()


@lru_cache(maxsize=1)
def _lexer():
    words: dict[str, tuple[str, object]] = {}
    for unit, names in UNIT_WORDS.items():
        for w in names.split():
            words[fold(w.replace("_", " "))] = ("UNIT", unit)
    for scale, names in SCALE_WORDS.items():
        for w in names.split():
            words[fold(w)] = ("SCALE", scale)
    for kind, names in (("PER", PER_WORDS), ("EACH", EACH_WORDS), ("TIMES", TIMES_WORDS)):
        for w in names.split():
            words.setdefault(fold(w), (kind, None))
    parts = []
    for w in sorted(words, key=len, reverse=True):
        pattern = r"\s*".join(re.escape(x) for x in w.split(" "))
        # Words in Latin letters end at a letter; other scripts are written without spaces.
        if w != "x" and (w[0].isascii() and w[0].isalpha() or w[0] in "éđ"):
            pattern = rf"(?<![^\W\d_]){pattern}"
        if w in ("x", "×"):
            pass  # may stand between two numbers without spaces
        elif w[-1].isascii() and w[-1].isalnum() or unicodedata.name(w[-1], "").startswith("LATIN"):
            pattern += r"(?:(?![^\W\d_])|(?=x\s*\d))"
        parts.append(pattern)
    word = re.compile("|".join(parts))
    # A space, dot, comma or apostrophe before exactly three digits groups; else dot or comma is the decimal sign.
    number = re.compile(r"\d{1,3}(?:([.,' ])\d{3}(?!\d))(?:\1\d{3}(?!\d))*(?:[.,]\d+)?|\d+(?:[.,]\d+)?")
    return words, word, number


def parse_number(text: str) -> Fraction:
    """One number as written; a leading zero before the sign ("0.125") makes it decimal."""
    m = re.fullmatch(r"(\d{1,3})((?:([.,' ])\d{3})(?:\3\d{3})*)(?:([.,])(\d+))?", text)
    if m and not (m[1].strip("0") == "" and m[3] in ".,"):
        if m[4] is None or m[4] != m[3]:
            whole = m[1] + re.sub(r"\D", "", m[2])
            return Fraction(f"{whole}.{m[5]}") if m[5] else Fraction(whole)
    return Fraction(text.replace(",", ".").replace(" ", "").replace("'", ""))


def tokens(text: str) -> list[tuple[str, object]]:
    """Tokens of a folded text; signs outside the grammar are ``("OTHER", text)``."""
    words, word, number = _lexer()
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif (m := number.match(text, i)) and m.end() > i:
            try:
                out.append(("NUMBER", parse_number(m[0])))
            except ValueError:
                out.append(("OTHER", m[0]))
            i = m.end()
        elif (m := word.match(text, i)) and m.end() > i:
            out.append(words[re.sub(r"\s+", "", m[0])] if re.sub(r"\s+", "", m[0]) in words else words[re.sub(r"\s+", " ", m[0])])
            i = m.end()
        else:
            if out and out[-1][0] == "OTHER":
                out[-1] = ("OTHER", out[-1][1] + text[i])
            else:
                out.append(("OTHER", text[i]))
            i += 1
    return out


@dataclass(frozen=True)
class Quantity:
    """Value in base units, exponent vector, currency, and whether a scale word was stated."""

    value: Fraction
    dims: Dims
    currency: str | None = None
    scaled: bool = False
    per: Unit | None = None


def _factors(toks):
    """Terms ``(number, scaled, unit, times)``, the per-units and loose currency units."""
    terms, pers, money = [], [], []
    i, times = 0, False
    while i < len(toks):
        kind, v = toks[i]
        if kind == "PER" and i + 1 < len(toks) and toks[i + 1][0] == "UNIT" and toks[i + 1][1].currency is None:
            pers.append(toks[i + 1][1])
            i += 2
            continue
        if kind == "UNIT" and i + 1 < len(toks) and toks[i + 1][0] == "EACH" and v.currency is None:
            pers.append(v)
            i += 2
            continue
        if kind == "NUMBER":
            scale, scaled, j = Fraction(1), False, i + 1
            while j < len(toks) and toks[j][0] == "SCALE":
                scale, scaled, j = scale * toks[j][1], True, j + 1
            unit = None
            if j < len(toks) and toks[j][0] == "UNIT" and toks[j][1].dims != TIME and not (j + 1 < len(toks) and toks[j + 1][0] == "EACH" and toks[j][1].currency is None):
                unit, j = toks[j][1], j + 1
            terms.append([v * scale, scaled, unit, times])
            i, times = j, False
            continue
        if kind == "TIMES":
            times = True
        elif kind == "UNIT":
            (money if v.currency else pers if v.dims == TIME else money).append(v)
        i += 1
    return terms, pers, money


def parse(text: str | None, want: Dims) -> Quantity | None:
    """Quantity of ``text`` read towards the dimensions ``want``; None where it holds no number.

    A unit that names both a length and an area, and a bare length where an area is wanted, are
    read as the area.  A product of two lengths is an area; a factor without a unit takes the
    other's.  Three numbers joined by hyphens before a land unit are rai, ngan and square wa.
    """
    if text is None:
        return None
    folded = fold(text)
    if want == AREA and (m := re.match(r"\D*?(\d+)\s*-\s*(\d+)\s*-\s*(\d+(?:[.,]\d+)?)(?!\d)", folded)):
        return Quantity(Fraction(m[1]) * 1600 + Fraction(m[2]) * 400 + Fraction(m[3].replace(",", ".")) * 4, AREA)
    terms, pers, loose = _factors(tokens(folded))
    if not terms:
        return None
    if want == MONEY:
        currency = next((u.currency for *_, u, _t in terms if u is not None and u.currency), None) or next((u.currency for u in loose if u.currency), None)
        total, last = Fraction(0), None
        for value, scaled, unit, _times in terms:
            if unit is not None and unit.currency is None:
                continue  # "for 3 rai" beside the amount
            if last is not None and not scaled:
                break  # a second bare number is not part of the amount
            if last is not None and value >= last:
                break
            total, last = total + value, value
        if last is None:
            return None
        per = None
        for u in pers:
            per = SQWA if u.either else SQM if u.dims == LENGTH and u.scale == 1 else u
            break
        return Quantity(total, MONEY, currency, any(t[1] for t in terms), per)
    # Lengths of falling units are one length: "5 feet 3 inches".
    joined: list = []
    for term in terms:
        own, last = term[2], joined[-1][2] if joined else None
        if not term[3] and own is not None and last is not None and own.dims == last.dims == LENGTH and own.scale < last.scale and term[0] * own.scale < last.scale:
            joined[-1] = [joined[-1][0] + term[0] * own.scale / last.scale, joined[-1][1], last, joined[-1][3], True]
        else:
            joined.append([*term, False])
    terms = joined
    if want == AREA and len(terms) == 1 and terms[0][4]:
        return None  # a length of two units is no area
    value, dims, i = Fraction(0), None, 0
    while i < len(terms):
        v, _scaled, unit, _times, _two = terms[i]
        if i + 1 < len(terms) and terms[i + 1][3]:
            unit = unit or terms[i + 1][2] or (loose[0] if loose else METRE)
            other = terms[i + 1][2] or unit
            if unit.dims == AREA:
                unit = METRE
            if other.dims == AREA:
                other = METRE
            part = Quantity((v * unit.scale + unit.offset) * (terms[i + 1][0] * other.scale + other.offset), AREA)
            i += 2
        elif unit is None and not (loose and len(terms) == 1):
            i += 1
            continue
        else:
            unit = unit or loose[0]
            if want == AREA and unit.dims == LENGTH:
                unit = Unit(AREA, unit.scale**2)
            part = Quantity(v * unit.scale + unit.offset, unit.dims)
            i += 1
        if part.dims != want:
            continue
        value, dims = value + part.value, part.dims
    return None if dims is None else Quantity(value, dims)


def half_even(value: Fraction) -> int:
    """Nearest whole number, half to even."""
    return round(value)
