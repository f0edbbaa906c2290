import numpy as np

from tamarind.llm import language
from tamarind.llm.language import code_of, fit, languages_of, segments, sentences_of

TEXTS = {
    "lo": ["ຂາຍທີ່ດິນປູກສ້າງ ທຳເລດີຫຼາຍ", "ອາກາດດີ ງຽບສະຫງົບ ເພື່ອນບ້ານດີ", "ໄຟຟ້າ ນ້ຳປະປາເຂົ້າເຖິງແລ້ວ", "Khay thi din yu ban tham le di lay", "Fai fa nam papa khao theung leo phom pouk sang"],
    "th": ["ขายที่ดินเปล่า ทำเลดีมาก", "บรรยากาศเงียบสงบ เพื่อนบ้านดี", "ไฟฟ้า น้ำประปาเข้าถึงแล้ว"],
    "en": ["Owner selling farm land, no agents please", "Quiet area with friendly neighbours", "The access road is sealed, trucks can pass"],
    "vi": ["Chính chủ bán đất vườn, vị trí rất đẹp", "Khu vực yên tĩnh, hàng xóm thân thiện", "Điện nước đã có sẵn, xây dựng được ngay"],
    "fr": ["Propriétaire vend un terrain agricole, très bien situé", "Quartier calme avec des voisins agréables", "Papiers complets, prêt pour le transfert"],
    "zh": ["业主直接出售土地，非诚勿扰", "环境安静，邻居友好", "水电已经接通，可以马上动工建设"],
}


def rows():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/records.parquet", columns=["text", "lang"]).to_pylist()
    return [(r["text"], r["lang"]) for r in t if r["text"]]


MODEL = fit(rows())


def label(text):
    parts = sentences_of(text)
    return [lang for lang, p in segments(parts, MODEL.log_probabilities([s for s, _ in parts])) if 0 < p <= 1.0001]


def test_single_and_mixed():
    for lang, texts in TEXTS.items():
        assert label(". ".join(texts[:3])) == [lang]
    assert label(TEXTS["vi"][0] + ". " + TEXTS["vi"][1] + "\n" + TEXTS["lo"][0] + " | 020 5555 1234 | #landforsale") == ["vi", "lo"]
    assert label("\n".join([TEXTS["en"][0], TEXTS["th"][0], TEXTS["th"][1], TEXTS["en"][1]])) == ["en", "th", "en"]


def test_codes():
    assert [code_of(x) for x in ("lo-LA", "LAO", "zh_CN", "fre", "und", "", None, "km")] == ["lo", "lo", "zh", "fr", None, None, None, "?"]


def test_probabilities_sum_to_one():
    logp = MODEL.log_probabilities(["khay thi din", "zzz", "x"])
    assert np.allclose(np.exp(logp).sum(1), 1) and MODEL.log_probabilities([]).shape == (0, 6)


def test_held_out_accuracy(spark):
    records = spark.read.parquet("/root/testdata/sf0.01/records.parquet")
    drawn = language.training_rows(records)
    model = fit(drawn[: len(drawn) // 2])
    right = total = 0
    for text, lang in drawn[len(drawn) // 2 :]:
        parts = sentences_of(text)
        if sum(n for _, n in parts) >= language.LEAST_LETTERS:
            total += 1
            right += code_of(lang) in {s for s, _ in segments(parts, model.log_probabilities([s for s, _ in parts]))}
    assert right / total > 0.93  # some labels are wrong by design


def test_query_edges(spark):
    df = spark.createDataFrame([("a", TEXTS["en"][0], "lo", 1), ("b", None, "lo", 2), ("c", "ok", None, 3), ("d", "", "", 4), (None, TEXTS["en"][0], "", 5), ("e", ". ".join(TEXTS["fr"] * 300), None, 6)], "key string, text string, lang string, segment_no int")
    got = {(r["record_key"], r["segment_no"], r["lang"]) for r in languages_of(df, MODEL).collect()}
    assert got == {("a", 0, "en"), ("e", 0, "fr")}
    assert languages_of(df.limit(0), MODEL).count() == 0
    assert len(fit([]).bias) == 6
