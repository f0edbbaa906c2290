import unicodedata

import pytest

from tamarind.llm.lookalike import look_classes, look_form, normalised, same_look_pairs, script_sets


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Land", "Lаnd"), ("KIP", "ΚΙΡ"), ("ＡＢ１", "AB1"), ("ban​kok", "bankok"), ("a b", "a b"), ("é", "é"), ("ນ້ຳ", "ນໍ້າ"), ("ແກ້ວ", "ເເກ້ວ"), ("แดง", "เเดง"), ("น้ำ", "นํ้า"),
        ("LS‑7", "LS-7"), ("ph­on", "phon"), ("ວຽງ﻿", "ວຽງ"), ("АВС", "ABC"), ("ρaypal", "paypal"), ("τest", "test"), ("ⅼogin", "login"), ("ɑpple", "apple"), ("𝐁𝐚𝐧𝐤", "Bank"), ("ꓡꓮꓠꓓ", "LAND"), ("Ⅻ", "XII"), ("🙏️", "🙏"), ("ໜອງ", "ຫນອງ"),
    ],
)
def test_same_look(a, b):
    assert look_form(a) == look_form(b)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("A", "a"), ("1", "l"), ("ban", "bán"), ("a b", "ab"), ("Привет", "Npибem"), ("a–b", "a-b"), ("👍", "??"), ("ກ", "ຂ"), ("👨‍👩", "👨👩")])
def test_other_look(a, b):
    assert look_form(a) != look_form(b)


def test_words_of_another_script_stay():
    assert look_form("Привет") == "Привет"
    assert unicodedata.normalize("NFC", look_form("")) == ""


def test_resolved_script_sets():
    assert script_sets("漢か") == (frozenset({"CJK", "JAPANESE", "KOREAN", "BOPOMOFO"}), frozenset({"HIRAGANA", "JAPANESE"}))
    assert script_sets("e\u0301") == script_sets("e") and "CYRILLIC" in script_sets("e")[0]  # a mark is inherited
    assert look_form("καλημέρα") == "καλημέρα" and look_form("λόγοs") == look_form("λόγοѕ")


def test_classes(spark):
    df = spark.createDataFrame([("k2", "Land"), ("k1", "Lаnd"), ("k3", "Land"), ("k4", "Sea"), ("k5", None)], "key string, text string")
    got = look_classes(df, "key", "text").collect()
    assert {(r["key"], r["class_key"]) for r in got} == {("k1", "k1"), ("k2", "k1"), ("k3", "k1")} and len({r["stored"] for r in got}) == 2


def test_pairs(spark):
    rows = [("k1", "Land", 1), ("k2", "Lаnd", 2), ("k3", "Land", 3), ("k3", "Land", 3), ("k4", None, 4), (None, "Lаnd", 5), ("k5", "", 6), ("k6", "Sea", 7), ("k7", "x" * 40000 + "é", 8), ("k8", "x" * 40000 + "é", 9)]
    df = spark.createDataFrame(rows, "key string, text string, look int")
    assert sorted(tuple(r) for r in same_look_pairs(df, "key", "text").collect()) == [("k1", "k2"), ("k2", "k3"), ("k7", "k8")]
    assert same_look_pairs(df.limit(0), "key", "text").count() == 0
    made = normalised(df, "text").collect()
    assert len(made) == len(rows) and {r["look"] for r in made if r["key"] in ("k1", "k2")} == {"Land"}
