import pytest

from tamarind.llm import residue
from tamarind.llm.residue import residue_kind, template_residue

REAL = "The plot lies 3 kilometres from the river and stays dry in the wet season. The roof was renewed 9 years ago and so was all of the wiring. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (REAL + "Location: {{ price | default }}.", "field"), (REAL + "Posted by %price% on %price%", "field"), (REAL + "Dear ${Name}, thank you", "field"), (REAL + "@@DISTRICT@@", "field"), (REAL + "<%= listing.price %>", "field"),
        (REAL + "[INSERT PRICE HERE]", "field"), (REAL + "Total area %s sqm", "field"), (REAL + "__Currency__", "field"), (REAL + "#{agent}", "field"), (REAL + "[[agent]]", "field"), (REAL + "{0}", "field"), (REAL + "<insert address>", "field"),
        (REAL + "ທີ່ຕັ້ງ: [ໃສ່ລາຄາບ່ອນນີ້]", "field"), (REAL + "[SOLD]", None), (REAL + "The contract form has blanks for [name] and [address]; fill them in by hand.", None), (REAL + "```\n{{ price }}\n```", None), (REAL + "Use `{{ price }}` for it.", None),
        (REAL + "About 100% sure, 5% less, a_b and c__d.", None), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod.", "filler"), (REAL + "Lorem Garden Residence is the name of the estate.", None), ("asdf asdf qwer asdf asdf qwer", "filler"),
        ("xxxxx xxxxx. xxxxx xxxxx. xxxxx", "filler"), ("Texte d'exemple Texte d'exemple", "filler"), ("Please enable JavaScript to view this listing.", "message"), ("ເຮືອນຂາຍ ປີ 1997\nHome | Listings | Contact\nHTTP 404\nnginx", "message"),
        ("ກະລຸນາເຂົ້າສູ່ລະບົບກ່ອນ ຈຶ່ງຈະເຫັນໂພສນີ້", "message"), ("ประกาศนี้ถูกลบหรือหมดอายุแล้ว", "message"), ("Trang không tồn tại hoặc đã bị xóa. Mã 403", "message"), ("页面不存在，错误代码 429", "message"), ('{"error":{"code":503,"message":"object not available"}}', "message"),
        (REAL + "She wrote that her tablet wants JavaScript enabled before it opens the map.", None), (REAL * 3 + "Their portal answered with error 502 when the buyers tried it, so they drove there", None), (REAL, None), ("", None), (None, None), ("ok", None),
    ],
)
def test_kinds(text, kind):
    assert residue_kind(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("410 Gone", "message"), ("Status: 503", "message"), ("Code 404", "message"), ("Mã 500", "message"), ("The site is temporarily down", "message"), ("Your account has been disabled", "message"), ("You must be a member of this group", "message"),
        ("blah, blah, blah", "filler"), ("sed sit non lorem sed sit", "filler"), ("Land 400 - 500 sqm for sale", None), ("Land for sale. Code 450.", None), ("Room 404 service charge included", None),
        ("Access denied\n" + "".join(f"{w} | {w[::-1]}\n" for w in sorted({a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr"})), "message"), ("Access denied\n" + REAL * 8, None),
    ],
)
def test_no_match_is_passed_over(text, kind):
    assert residue_kind(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The Jinja tutorial: write {{ user.name }} where the name belongs.", None), ("Use ${HOME} as the base path", None), ("In Python f-strings, {name} is replaced by its value", None), ("See __init__ method for more", None),
        ("Dear ${Name}, your visit is on {date}.", "field"), ("Contact {{ agent }} for the variable price.\nPhone: {{ phone }}", "field"), ("Por favor habilite JavaScript para continuar", "message"), ("Seite nicht gefunden. Fehler 404", "message"),
        (REAL * 2 + "Error 503 came up when we opened the map, but the photos loaded.", None),
    ],
)
def test_context_of_fields_and_messages(text, kind):
    assert residue_kind(text) == kind


def test_each_alternative_is_found_by_its_literals():
    for k, a in enumerate(residue._PHRASES):
        held = residue._literals(residue.parse(a, residue.re.I))[1]
        assert held and all(w == residue._folded(w) and len(w) > 1 for w in held)
    for text in ("HTTP 599", "page could not be found", "\u017fign in required", "LỖI MÁY CHỦ", "verifying you are human", "phiên đã hết hạn"):
        folded = residue._folded(text)
        assert [k for k, p in enumerate(residue._SINGLE) if p.search(text)] and all(any(w in folded for w in residue._literals(residue.parse(residue._PHRASES[k], residue.re.I))[1]) for k, p in enumerate(residue._SINGLE) if p.search(text))


def test_query(spark):
    df = spark.createDataFrame([(1, REAL, "a"), (2, "{{x}}", "a"), (2, "{{x}}", "a"), (3, None, "a"), (4, "word " * 100000 + "{{ title }}", "a")], "doc_id long, text string, kind string")
    assert sorted(tuple(r) for r in template_residue(df).collect()) == [(2, "field"), (2, "field"), (4, "field")]
    assert template_residue(df.limit(0)).count() == 0
