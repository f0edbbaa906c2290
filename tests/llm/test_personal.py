import numpy as np
import pytest

from tamarind.llm import boosting, personal
from tamarind.llm.personal import personal_spans, redacted, spans_of, taught_sentences, trained

MODELS = trained()


def found(text):
    return {(k, text[s:e]) for k, s, e in spans_of([text], MODELS)[0]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call 020 3487 5669", {("PHONE", "020 3487 5669")}), ("ສົນໃຈໂທຫາ +໘໕໖ ໒໐ ໑໒໐໕໕໕໐໓ ໄດ້ຕະຫຼອດ", {("PHONE", "+໘໕໖ ໒໐ ໑໒໐໕໕໕໐໓")}), ("WhatsApp (020) 30.781.017", {("PHONE", "(020) 30.781.017")}),
        ("Survey sheet 020/06 6089 18 can be seen at the office", set()), ("Papers are complete, plot number 44555119, ready for transfer", set()), ("Passport number 52/65 632495 is used for the contract", {("ID_NUMBER", "52/65 632495")}),
        ("ບັດປະຈຳຕົວເຈົ້າຂອງເລກທີ PA7145612", {("ID_NUMBER", "PA7145612")}), ("Email: oudom.khanh (at) dinlao (dot) example", {("EMAIL", "oudom.khanh (at) dinlao (dot) example")}), ("Two rooms @ 5 dollars a night are let at present", set()),
        ("ສົ່ງເອກະສານມາ ເຮືອນເລກທີ 290/13 ໜ່ວຍ 16 ບ້ານເດື່ອແດງ", {("ADDRESS", "290/13 ໜ່ວຍ 16 ບ້ານເດື່ອແດງ")}), ("The seller lives at 135/12, Soi 9, Pakkhok St", {("ADDRESS", "135/12, Soi 9, Pakkhok St")}), ("ຕິດທາງເລກ 13 ຫຼັກ 7", set()),
        ("ຖາມຫາ ນາງ ດາວເວດ ຈິດພົມ ໄດ້ທຸກເວລາ", {("NAME", "ດາວເວດ ຈິດພົມ")}), ("The owner is Ms Phonelat VONGSAK", {("NAME", "Phonelat VONGSAK")}), ("Looking to buy land around Ban Thong Nam, cash ready", set()), ("ลำดับ ราคา 3,050,000 บาท", set()), ("", set()),
    ],
)
def test_places(text, want):
    assert found(text) == want


def test_offsets_are_of_the_text_as_stored():
    text = "​Ca​ll 02​0 3487 5669 now"
    assert spans_of([text], MODELS)[0] == [("PHONE", text.index("0"), text.index(" now"))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The seller lives at 12/3, Unit 5, Phonkham Road, Ban Nongbone", "The seller lives at [ADDRESS]"), ("Address: 27 Rue Setthathirath, Vientiane", "Address: [ADDRESS]"),
        ("Contact person: Nguyễn Văn An", "Contact person: [NAME]"), ("请找王小明先生面谈", "请找[NAME]先生面谈"), ("Demandez monsieur Éric Dupré sur place", "Demandez monsieur [NAME] sur place"),
        ("Ask for Mary Jane Watson directly", "Ask for [NAME] directly"), ("My name is Somchai", "My name is [NAME]"), ("The owner is Ms Houngheuanghoung VONGSAK. Call 020 3487 5669", "The owner is Ms [NAME]. Call [PHONE]"),
        ("The access road is 6 metres wide, Unit price 500 kip", "The access road is 6 metres wide, Unit price 500 kip"), ("ຂາຍສາງເກັບເຄື່ອງ ຢູ່ ບ. ໜອງແດງ", "ຂາຍສາງເກັບເຄື່ອງ ຢູ່ ບ. ໜອງແດງ"),
    ],
)
def test_redacted_text(text, want):
    for kind, s, e in reversed(spans_of([text], MODELS)[0]):
        text = f"{text[:s]}[{kind}]{text[e:]}"
    assert text == want


def test_held_out_sentences():
    made = taught_sentences(400, seed=99)
    right = wrong = missed = 0
    for (_, cases), spans in zip(made, spans_of([t for t, _ in made], MODELS)):
        got, true = {(k, s) for k, s, _ in spans}, {(k, s) for k, s, _ in cases}
        right, wrong, missed = right + len(got & true), wrong + len(got - true), missed + len(true - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_trees_learn_a_rule():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = (x[:, 0] > 0.5) & (x[:, 2] < 0.3)
    model = boosting.fit(x, y)
    assert ((model.probabilities(x) >= model.threshold) == y).mean() > 0.98


def test_queries(spark):
    df = spark.createDataFrame([("a", "Call 020 3487 5669 today", 1), ("b", None, 2), ("c", "", 3), ("d", "word " * 20000 + "Call 020 3487 5669", 4), (None, "Call 020 3487 5669", 5)], "key string, text string, span_start int")
    assert {(r["key"], r["pii_type"], r["span_start"]) for r in personal_spans(df).collect()} == {("a", "PHONE", 5), ("d", "PHONE", 100005)}
    assert {r["key"]: r["redacted"] for r in redacted(df).where("key in ('a','b','c')").collect()} == {"a": "Call [PHONE] today", "b": None, "c": ""}
    assert personal_spans(df.limit(0)).count() == 0
    assert personal.KINDS[0] == "EMAIL"
