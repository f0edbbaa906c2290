import pytest

from tamarind.llm.gazetteer import UNMATCHED, PlaceIndex, fold_latin, map_places

PARTS = [("ທອງ", "thong"), ("ຄຳ", "kham"), ("ໜອງ", "nong"), ("ຫີນ", "hin"), ("ສະຫວັນ", "savan"), ("ເໜືອ", "neua"), ("ແກ້ວ", "keo"), ("ດອນ", "don")]
VILLAGES = [(f"V{i}{j}{k}", f"D{i}", ["".join(PARTS[x][0] for x in (i, j, k)), "".join(PARTS[x][1] for x in (i, j, k)).capitalize()]) for i in range(8) for j in range(8) for k in range(8) if len({i, j, k}) == 3 and (i + j + k) % 2 == 0]
VILLAGES.append(("V900", "D1", VILLAGES[0][2]))
DISTRICTS = [("D0", None, ["ວຽງພິໄລ", "Viengphilay", "เวียงพิไล"]), ("D1", None, ["ອຸດົມທານີ", "Oudomthani"])]
INDEX = PlaceIndex(VILLAGES, DISTRICTS)
LO, EN = VILLAGES[5][2]
CODE = VILLAGES[5][0]


@pytest.mark.parametrize("text", [f"ບ້ານ{LO}", f"ບ. {LO} ✅", f"Ban {EN.upper()} !!", f"village {EN}, Viengphilay District", EN, " ".join(LO), LO[:3] + LO[2:], EN[:5] + EN[4:]])
def test_found(text):
    assert INDEX.resolve(text) == CODE


def test_homonyms_need_the_district():
    name = VILLAGES[0][2][0]
    assert INDEX.resolve(f"ບ້ານ{name}") == UNMATCHED
    assert INDEX.resolve(f"ບ້ານ{name} ເມືອງອຸດົມທານີ") == "V900"
    assert INDEX.resolve(f"ບ້ານ{name} (Viengphilay)") == VILLAGES[0][0]


@pytest.mark.parametrize("text", ["near Viengphilay town", "ເມືອງອຸດົມທານີ", "", None, "!!", "ທອງທອງທອງ", "Thongthongkham", "x" * 5000])
def test_not_found(text):
    assert INDEX.resolve(text) == UNMATCHED


def test_romanisations_fold_to_one():
    assert fold_latin("Hinneuasavan") == fold_latin("Hinnuasawan") == fold_latin("hin neua sawan")


def test_query(spark):
    v = spark.createDataFrame([(c, d, n[0], n[1], None) for c, d, n in VILLAGES], "code string, district_code string, name_lo string, name_en string, name_variants array<string>")
    d = spark.createDataFrame([(c, n[0], n[1], n[2:]) for c, _, n in DISTRICTS], "code string, name_lo string, name_en string, name_variants array<string>")
    values = spark.createDataFrame([(LO, 1), ("no place", 2)], "value_text string, village_code int")
    assert {tuple(r) for r in map_places(values, v, d).collect()} == {(LO, CODE), ("no place", UNMATCHED)}
