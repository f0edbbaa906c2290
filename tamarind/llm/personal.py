"""Problem 2: personal information inside free text.

Generators of high recall propose overlapping spans of five kinds.  Boosted
trees judge each span by its format and by the cue words around it.  They are
trained on sentences composed by rule: cue words, made-up words of four scripts
and made-up values, in random order and number; no sentence of any corpus is
among them.  Thresholds are set on held-out ones.  Of overlapping accepted spans
the most probable stays; an address goes on over the unit, road and village that
follow its house number.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tamarind.functions.frames import frame
from tamarind.llm import boosting
from tamarind.llm.lookalike import LATIN_OF
from tamarind.session import table

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Cue words by class, in folded lower case; a blank stands for any white space.
CUES = {
    "phone": "☎|📞|call|tel|phone|mobile|whatsapp|contact us on|contact|viber|zalo|wechat|line|ໂທ|ເບີ|ວັອດແອັບ|ແອັດໄລນ໌|ຕິດຕໍ່|โทร|เบอร์|ติดต่อ|ไลน์|liên hệ|điện thoại|gọi|sđt|téléphone|téléphonez|appelez|电话|手机|联系|tho|tit tor|微信",
    "identity": "ບັດປະຈຳຕົວ|ບັດປະຈໍາຕົວ|ໜັງສືຜ່ານແດນ|ຫນັງສືຜ່ານແດນ|ຜ່ານແດນ|ສຳມະໂນຄົວ|ສໍາມະໂນຄົວ|บัตรประชาชน|ประจำตัวประชาชน|ประจําตัวประชาชน|ประชาชน|หนังสือเดินทาง|ทะเบียนบ้าน|passport|identity card|id card|id no|id number|family book|carte d'identité|passeport|livret de famille|căn cước|hộ chiếu|cmnd|cccd|sổ hộ khẩu|身份证|护照|户口|bat pachamtua|pachamtua|nangsue phan daen|phan daen|samano",
    "plot": "ແຜນທີ່ດິນ|ແຜ່ນເລກ|ໃບຕາດິນ|ເລກຕອນ|ຕອນດິນ|ระวาง|แผนที่|โฉนด|เลขแปลง|แปลง|survey sheet|sheet|plot number|plot|parcel|parcelle|title deed|thửa|tờ bản đồ|bản đồ|地块|地籍|图幅|ta din|lek ton|phaen thi|cadastral|plan n",
    "code": "ລະຫັດ|ອ້າງອີງ|รหัส|อ้างอิง|listing code|code|ref|reference|référence|mã tin|编号|lahat|ang ing|advert no|ad no",
    "price": "ລາຄາ|ກີບ|ບາດ|ໂດລາ|ຂໍປ່ອຍ|ราคา|บาท|ดอลลาร์|ปล่อย|price|kip|baht|usd|lak|thb|dollar|asking|giá|kíp|đô la|prix|价格|基普|泰铢|美元|lakha|kho poy|₭|฿|$|ລ້ານ|ຕື້|ແສນ|ล้าน|แสน|million|billion|triệu|tỷ|万",
    "size": "ເນື້ອທີ່|ຂະໜາດ|ຂະຫນາດ|ດິນທັງໝົດ|ຕາແມັດ|ແມັດ|ໄຮ່|ໜ້າກວ້າງ|ກວ້າງ|เนื้อที่|ขนาด|ตาราง|ไร่|เมตร|กว้าง|area|sqm|m2|m²|square|rai|metre|meter|feet|ft|size|diện tích|mặt tiền|superficie|façade|面积|平方|米|neua thi|na kuang|km",
    "route": "ທາງເລກ|ຫຼັກ|ຫັຼກ|ถนนสาย|กิโลเมตรที่|กม|route|highway|km post|road no|quốc lộ|国道|公路|thang lek|lak",
    "house": "ເຮືອນເລກທີ|ເຮືອນເລກ|ບ້ານເລກທີ|ທີ່ຢູ່|บ้านเลขที่|ที่อยู่|house no|house number|lives at|live at|address|meet us at|office at|come to|nhà số|số nhà|địa chỉ|numéro|au n|adresse|habite|rendez-vous|门牌|地址|住在|heuan lek|thi yu",
    "street": "ໜ່ວຍ|ຫນ່ວຍ|ຮ່ອມ|ຖະໜົນ|ຖະຫນົນ|ຖ.|ซอย|หมู่|ถนน|ถ.|soi|unit|rd|road|street|st|lane|alley|ngõ|đường|phường|rue|avenue|号|路|巷|街|thanon|hom|nuay",
    "title": "ທ້າວ|ນາງ|ທ່ານ|ນາຍ|ເອື້ອຍ|ອ້າຍ|ລຸງ|ປ້າ|นาย|นาง|นางสาว|คุณ|mr|mrs|ms|miss|anh|chị|ông|bà|monsieur|madame|mme|m.|先生|女士|thao|nang|than|khun|euay|ai",
    "person": "ຖາມຫາ|ຜູ້ປະສານງານ|ກັບ|ເຈົ້າຂອງດິນຊື່|ຊື່|ຕິດຕໍ່|ผู้ประสานงาน|กับ|ถามหา|ติดต่อ|ชื่อ|contact person|ask for|talk to|speak to|owner is|seller is|agent is|name is|gặp|hỏi|tên|demandez|s'adresser à|propriétaire est|请找|联系人|找|tham ha|khong sue|phop|sue",
    "after name": "ໄດ້ທຸກເວລາ|ໂດຍກົງ|ກ່ອນ|ล่วงหน้า|โดยตรง|ได้ทุกเวลา|directly|will show|first|any time|để xem|để được|sur place|面谈|dai thouk|will meet",
    "firm": "ໂຮງແຮມ|ຮ້ານ|ບໍລິສັດ|ຫ້າງ|โรงแรม|ร้าน|บริษัท|ห้าง|hotel|shop|company|co.|ltd|group|bank|school|market|temple|công ty|khách sạn|société|banque|hôtel|公司|酒店|bolisat|honghaem|restaurant|coffee",
    "place": "ບ້ານ|ເມືອງ|ບ.|ມ.|บ้าน|เมือง|หมู่บ้าน|ban|baan|village|muang|district|town|bản|làng|b.|near|at|around|located in|ใกล้|ໃກ້",
}
CLASSES = tuple(CUES)
BEFORE, AFTER, FAR = 42, 24, 60


@lru_cache(maxsize=1)
def _cues():
    a = ahocorasick.Automaton()
    words: dict[str, list[int]] = {}
    for k, names in enumerate(CUES.values()):
        for w in names.split("|"):
            words.setdefault(w, []).append(k)
    for w, kinds in words.items():
        a.add_word(w, (len(w), kinds, w[0].isascii() and w[0].isalpha(), w[-1].isascii() and w[-1].isalpha()))
    a.make_automaton()
    return a


class _Fold(dict):
    """One sign for each sign: widths, digits of all scripts, blanks, look-alike letters."""

    def __missing__(self, code: int):
        ch = chr(code)
        to = ch
        kind = unicodedata.category(ch)
        if kind == "Nd":
            to = str(unicodedata.digit(ch))
        elif kind == "Zs":
            to = " "
        elif ch in LATIN_OF:
            to = LATIN_OF[ch]
        elif ch in "‐‑‒–—−－":
            to = "-"
        elif len(n := unicodedata.normalize("NFKC", ch)) == 1 and ch not in "ຳำ²³":
            to = n
        self[code] = to
        return to


_fold = _Fold()
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")

_EMAIL = re.compile(r"(?i)[a-z0-9][\w.+\-]*(?: ?@ ?| ?[(\[] ?at ?[)\]] ?)[a-z0-9][\w\-]*(?:(?: ?[(\[] ?dot ?[)\]] ?|\.)[a-z0-9][\w\-]*)*", re.A)
_NUMBER = re.compile(r"(?<![\w.,/])(?:\b[A-Z]{1,2}(?=\d{6,8}(?!\w)))?(?:\+ ?|\()?\d[\d ().\-/]{4,24}\d(?![\w/])|(?<![\w])[A-Z]{1,2}\d{6,8}(?!\w)", re.A)
_HOUSE = re.compile(r"(?<![\w.,/\-+)])\d{1,4}(?:/\d{1,4})?(?![\d/a-z])(?!\.\d|,\d)")
_UPPER = "".join(chr(c) for c in [*range(0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c)) == "Lu")
_LETTER = "A-Za-z" + "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isalpha()) + "̀-ͯ"
#: A word that begins with a capital: a part of a Latin name, of any length, with accents.
_CAPITAL = rf"[{_UPPER}][{_LETTER}]*(?:['’\-][{_LETTER}]+)*"
_CAPITALS = re.compile(rf"(?<![{_LETTER}\d_@]){_CAPITAL}(?:[ ]{_CAPITAL})*")
_LAO, _THAI = "ກ-ຮະ-ໄ່-ໍໜໝໆ", "ก-ฮะ-์ๆ"
_NATIVE_NAME = re.compile(rf"[ :.]{{0,3}}((?:[{_LAO}]+(?: [{_LAO}]+)?|[{_THAI}]+(?: [{_THAI}]+)?))(?![ກ-ໟก-๛])")
# The most common Chinese family names.
_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_NAME = re.compile(rf"[{_FAMILIES}][一-鿿]{{1,2}}")
# What may follow a house number: a unit, a road, a village or district with its name, a town after a comma.
_PART = re.compile(
    rf"(?i:号)?[ ,，、]{{0,3}}(?:"
    rf"(?i:units?|soi|lane|alley|room|floor|apt|no|ngõ|ngách|hẻm|tổ|nuay|hom|lô)\.? ?(?:\d[\d/]*|{_CAPITAL})"
    rf"|(?:ໜ່ວຍ|ຫນ່ວຍ|ຮ່ອມ|ຊອຍ|หมู่ที่|หมู่|ม\.|ซอย|ซ\.)\.? ?(?:\d[\d/]*|[{_LAO}{_THAI}]+)"
    rf"|(?:ຖະໜົນ|ຖະຫນົນ|ຖ\.|ບ້ານ|ບ\.|ເມືອງ|ມ\.|ແຂວງ|ถนน|ถ\.|บ้าน|บ\.|ตำบล|แขวง|อำเภอ|เมือง|เขต|จังหวัด) ?[{_LAO}{_THAI}]+"
    rf"|(?i:rue|avenue|boulevard|bd|place|chemin|route|thanon|đường|phố|phường|quận|xã|huyện|ban|baan|bản|làng|muang|village|district)\.? (?:(?:de|du|des|la|le|l') ?)*{_CAPITAL}(?: {_CAPITAL}){{0,3}}"
    rf"|{_CAPITAL}(?: {_CAPITAL}){{0,3}} (?i:road|rd|street|st|lane|ave|avenue|boulevard|district|province)\b\.?"
    rf"|(?:[一-鿿]{{1,8}}?|[A-Z][A-Za-z ]{{1,24}}?)(?:路|街|巷|村|区|市|县)|\d+(?:巷|弄|室|楼|号)"
    rf"|(?<=[,，] ){_CAPITAL}(?: {_CAPITAL})?(?=[.,\n]|$))"
)
_SENTENCE = re.compile(r"[\n|]|[.!?](?= )|[。！？]")
#: Words no name begins with.
_NO_NAME = frozenset(w.split(" ")[0] for words in CUES.values() for w in words.split("|")) | {"dr", "house", "the", "please", "ask"}
_AFTER_HAN = ("先生", "女士", "小姐")
FEATURES = 2 * len(CLASSES) + 23


class Folded:
    """A text folded sign by sign, with the places of its signs in the text as stored and its cues."""

    def __init__(self, text: str):
        s = text.translate(_fold)
        self.places = None
        if _INVISIBLE.search(s):
            self.places = [i for i, c in enumerate(s) if not _INVISIBLE.match(c)]
            s = "".join(s[i] for i in self.places)
        self.text = s
        low = s.lower()
        if len(low) != len(s):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        self.cues = []
        n = len(low)
        for end, (length, kinds, left, right) in _cues().iter(low):
            start = end + 1 - length
            if left and start and low[start - 1].isalpha() or right and end + 1 < n and low[end + 1].isalpha():
                continue
            # Inside a Lao or Thai syllable: behind a vowel written first, or before a vowel or tone sign.
            if start and low[start - 1] in "ເແໂໃໄเแโใไ" or end + 1 < n and (low[end + 1] in "ະາຳะาำ" or unicodedata.category(low[end + 1]) == "Mn") and not low[end].isascii():
                continue
            self.cues.append((start, end + 1, kinds))
        self.breaks = [m.start() for m in _SENTENCE.finditer(s)]

    def stored(self, i: int) -> int:
        return i if self.places is None else self.places[i] if i < len(self.places) else self.places[-1] + 1

    def address_end(self, end: int) -> int:
        """Where the address of a house number ends that itself ends at ``end``."""
        while (m := _PART.match(self.text, end)) and m.end() > end:
            end = m.end()
        return end + (self.text[end : end + 1] == "号")

    def candidates(self) -> list[tuple[str, int, int]]:
        """Spans ``(kind, start, end)`` that may be personal, by generators that may overlap."""
        s, out = self.text, []
        if "@" in s or "(" in s or "[" in s:
            out += [("EMAIL", m.start(), m.end()) for m in _EMAIL.finditer(s)]
        for m in _NUMBER.finditer(s):
            digits = sum(map(str.isdigit, m[0]))
            end = m.end()
            if digits >= 6:
                out += [("PHONE", m.start(), end), ("ID_NUMBER", m.start(), end)]
        near = [(a, b) for a, b, kinds in self.cues if 7 in kinds or 8 in kinds]
        if near:
            for m in _HOUSE.finditer(s):
                if any(0 <= m.start() - b <= 14 or 0 <= a - m.end() <= 24 for a, b in near):
                    out.append(("ADDRESS", m.start(), self.address_end(m.end())))
        people = {b: 9 in kinds for _, b, kinds in self.cues if 9 in kinds or 10 in kinds}
        cued = {(a, b) for a, b, _ in self.cues}
        for m in _CAPITALS.finditer(s):
            words = [(w.start() + m.start(), w.end() + m.start()) for w in re.finditer("[^ ]+", m[0])]
            for i, (start, _) in enumerate(words):
                if s[start : words[i][1]].lower() in _NO_NAME:
                    continue
                led = any(start - d in people for d in (0, 1, 2, 3))
                out += [("NAME", start, end) for _, end in words[i + (not led) : i + 4]]
        for b in people:
            if not s[b - 1].isascii() and (m := _NATIVE_NAME.match(s, b)) and (m.start(1), m.start(1) + len(m[1].split(" ")[0])) not in cued:
                out.append(("NAME", m.start(1), m.end(1)))
        for m in _HAN_NAME.finditer(s):
            if any(m.start() - d in people for d in (0, 1, 2)):
                out.append(("NAME", m.start(), m.end()))
            for end in {m.start() + 2, m.end()}:
                if s[end : end + 2] in _AFTER_HAN or s[end : end + 1] == " " and s[end + 1 : end + 3] in _AFTER_HAN:
                    out.append(("NAME", m.start(), end))
        return list(dict.fromkeys(out))

    def features(self, kind: str, start: int, end: int) -> np.ndarray:
        """Distance to the nearest cue of each class before and behind, and the span's format."""
        s = self.text
        k = bisect_left(self.breaks, start)
        begin = self.breaks[k - 1] + 1 if k else 0
        # A full stop inside a number or after a short word does not end what belongs to it.
        begin = max(begin - 12, 0) if begin and s[begin - 1] == "." and start - begin < 14 else begin
        stop = self.breaks[bisect_left(self.breaks, end)] if bisect_left(self.breaks, end) < len(self.breaks) else len(s)
        f = np.full(FEATURES, float(FAR))
        n = len(CLASSES)
        for a, b, kinds in self.cues:
            if b <= start and a >= begin and start - b <= BEFORE:
                for c in kinds:
                    f[c] = min(f[c], start - b)
            elif a >= end and a < stop and a - end <= AFTER:
                for c in kinds:
                    f[n + c] = min(f[n + c], a - end)
        span = s[start:end]
        # Capitals beside a name: parts of it that the span leaves out.
        beside = (start > 1 and s[start - 1] == " " and s[s.rfind(" ", 0, start - 1) + 1].isupper(), s[end : end + 1] == " " and s[end + 1 : end + 2].isupper()) if kind == "NAME" else (0, 0)
        span = _HOUSE.match(s, start)[0] if kind == "ADDRESS" and _HOUSE.match(s, start) else span
        digits = [g for g in re.split(r"\D+", span) if g]
        flat = "".join(digits)
        first, _, second = span.partition(" ")
        f[2 * n :] = (
            len(flat), len(digits), max(map(len, digits), default=0), min(map(len, digits), default=0), len(digits[0]) if digits else 0,
            span.startswith("+") or flat.startswith(("00856", "0066")), span.startswith("("), flat.startswith("0"), flat.startswith(("020", "030", "021")), flat.startswith(("856", "66", "00856")),
            "/" in span, "." in span, "-" in span, span[:1].isalpha(), len(span), len(first), len(second), second.isupper(), start - begin, stop - end, span.count(" "), *beside,
        )
        return f


_SYLLABLES = {
    "n": ("Kham Boun Seng Phet Thong Souk Mani Vila Chan Somph Noy Lek Keo Dao", "vanh phone sak xay la dy nou mala vong thip kone lath savat chit"),
    "k": ("ຄຳ ບຸນ ແສງ ເພັດ ທອງ ສຸກ ມະນີ ຈັນ ສົມ ນ້ອຍ ແກ້ວ ດາວ ນາງ ໄຊ", "ວັນ ພອນ ສັກ ໄຊ ລາ ດີ ມາລາ ວົງ ທິບ ກອນ ລັດ ສະຫວາດ ຈິດ ພົມ"),
    "o": ("คำ บุญ แสง เพชร ทอง สุข มณี จัน สม น้อย แก้ว ดาว ศรี ชัย", "วัน พร ศักดิ์ ชัย ลา ดี มาลา วงศ์ ทิพย์ กร รัตน์ สวาท จิตร พรหม"),
    "l": ("ໂພນ ດອນ ໜອງ ຫ້ວຍ ນາ ທ່າ ໂນນ ພູ ວຽງ ປາກ", "ຂາມ ແພງ ນ້ອຍ ໃຫຍ່ ຄຳ ສີ ເງິນ ຫຼວງ"),
    "m": ("โพน ดอน หนอง ห้วย นา ท่า โนน ภู เวียง ปาก", "ขาม แพง น้อย ใหญ่ คำ สี เงิน หลวง"),
    "v": ("Phon Don Nong Houay Na Tha Non Phou Vieng Pak", "kham phaeng noy nyai sy ngeun louang mai"),
    "r": ("Phon Don Nong Houay Lane Tha Non Phou Vieng Pak", "kham xang sy ngeun luang tai neua"),
}


# Signs of which made-up words are put together, words between them, names with accents.
_WORDS = {
    "latin": "ka lo mi ter sen du vo ran pe hong nuy sa te lin gor ba".split(), "lao": "ກາ ລໍ ມີ ເຕ ແສນ ດຸ ໂວ ຣານ ເປ ຫົງ ນຸຍ ສາ ເທ ລິນ ກໍ ບາ".split(),
    "thai": "กา ลอ มี เต แสน ดุ โว ราน เป หง นุย สา เท ลิน กอ บา".split(), "han": list("天地上下大小多少前后左右东西南北新旧好看"),
}
_FILLERS = "the a of and is for to in on with this that it we you at from by or as be la le de et un une des pour est và của là cho một các có không những kap yu mi pen bo".split()
_ACCENTED = "Nguyễn Trần Lê Phạm Hoàng Đặng Bùi Đỗ Ngô Văn Thị Hữu Minh Ngọc Anh Éric Dupré François Hélène Benoît Zoé Noël Chloé Étienne José Müller O'Brien Jean-Pierre Watson Jane Mary".split()


def _script_of(word: str) -> str:
    return next((n for n, a, b in (("lao", "\u0e80", "\u0eff"), ("thai", "\u0e00", "\u0e7f"), ("han", "\u4e00", "\u9fff")) if any(a <= c <= b for c in word)), "latin")


def taught_sentences(count: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences composed by rule, with the kinds, starts and ends of what is personal in them (of an address, its house number)."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda k: pick(_SYLLABLES[k][0].split()) + "".join(pick(_SYLLABLES[k][1].split()) for _ in range(int(pick([1, 1, 2, 3]))))

    def grouped(s, sizes, sep):
        out = []
        for n in sizes:
            out.append(s[:n])
            s = s[n:]
        return sep.join(x for x in [*out, s] if x)

    def fill(slot):
        if slot == "p":
            sep = pick([" ", ".", "-", "", " "])
            body = grouped(pick("123579") + digits(7), pick([(2, 2, 2, 2), (2, 3, 3), (4, 4), (2, 6), (8,)]), sep)
            return pick(["020 ", "020 ", "020-", "020", "(020) ", "+856 20 ", "+85620", "00856 20 ", "+856 20", "030 ", ""][:-1]) + body if rng.random() < 0.75 else pick([f"01{digits(1)}-{digits(3)}-{digits(4)}", f"01{digits(8)}", f"+66 1{digits(1)} {digits(3)} {digits(4)}", f"08{digits(8)}", f"021 {digits(6)}", f"+84 9{digits(8)}"])
        if slot == "i":
            return pick([f"P{digits(7)}", f"PA{digits(7)}", f"{digits(2)}-{digits(7)}", digits(11), grouped(digits(11), (3, 3, 3, 2), " "), f"{digits(2)}/{digits(2)} {digits(6)}", digits(13), grouped(digits(13), (1, 4, 5, 2, 1), pick([" ", "-"])), f"{pick('ABM')}{digits(8)}"])
        if slot == "h":
            return str(rng.integers(1, 400)) + (f"/{rng.integers(1, 21)}" if rng.random() < 0.5 else "")
        if slot in "nko":
            first, last = word(slot), word(slot)
            if slot == "n":
                last = last.capitalize()
                last = last.upper() if rng.random() < 0.25 else last
            return f"{first} {last}"
        if slot == "e":
            at, dot = pick([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("(at)", ".")])
            return word("n").lower() + pick(["", ".land", "_x"]) + digits(int(rng.integers(0, 4))) + at + pick(["mail", "post", "laonet"]) + dot + pick(["example", "test", "la", "com"])
        if slot == "c":
            return pick(["LS-", "MB ", "KD", "AX-"]) + "".join(pick("23456789" if rng.random() < 0.9 else "ABCDEFGHJK") for _ in range(6)) if rng.random() < 0.3 else pick(["LS-", "MB ", "KD", "AX-"]) + "".join(pick("23456789ABCDEFGHJK") for _ in range(6))
        if slot == "s":
            return pick([f"{digits(2)}.{digits(4)}/{digits(2)}", f"0{digits(3)}-{digits(4)}-{digits(2)}", f"020/{digits(2)} {digits(4)} {digits(2)}", f"02{digits(2)}-{digits(4)}-{digits(2)}", f"020/{digits(2)}.{digits(4)}.{digits(2)}", f"020/{digits(2)} {digits(2)} {digits(2)} {digits(2)}"])
        if slot == "t":
            return digits(8)
        if slot == "a":
            return pick([f"{rng.integers(1, 99)},{digits(3)},000", f"{rng.integers(1, 9)}.{digits(3)}.000.000", f"{rng.integers(100, 999)} 000 000", digits(9), str(rng.integers(1, 999)) + "000", str(rng.integers(1, 99)) + "00000", f"{rng.integers(1, 9)} {digits(3)} 000 000"])
        return word(slot)

    def words(script, least, most):
        """Made-up words; Lao, Thai and Chinese ones mostly without blanks."""
        made = [pick(_FILLERS) if script == "latin" and rng.random() < 0.5 else "".join(pick(_WORDS[script]) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(least, most + 1)))]
        return (" " if script == "latin" or rng.random() < 0.3 else "").join(made)

    def name(script):
        """A person: mostly two words, sometimes one or three; Chinese ones in two or three signs."""
        if script == "han" and rng.random() < 0.6:
            return pick(_FAMILIES) + "".join(pick("明伟芳娜敏静丽强磊军洋勇艳杰娟涛超秀霞平刚") for _ in range(int(rng.integers(1, 3))))
        slot = {"lao": "k", "thai": "o"}.get(script, "n")
        made = [word(slot) if slot != "n" or rng.random() < 0.8 else pick(_ACCENTED) for _ in range(int(pick([1, 2, 2, 2, 2, 2, 2, 3] if slot == "n" else [1, 2, 2, 2])))]
        if slot == "n":
            made = [w[:1].upper() + w[1:] for w in made]
            made[-1] = made[-1].upper() if len(made) > 1 and rng.random() < 0.25 else made[-1]
        return " ".join(made)

    def cue(group, script):
        return pick([w for w in CUES[group].split("|") if _script_of(w) == script] or [w for w in CUES[group].split("|") if _script_of(w) == "latin"])

    def sentence():
        """``(text, cases)`` of one cue with its value, or of a value that is nothing personal."""
        script = pick(["latin", "latin", "latin", "lao", "lao", "thai", "han"])
        wide = script == "latin"
        gap = lambda: " " if wide else pick(["", " "])
        more = lambda: pick(["", " "]) + words(script, 1, 2) if not wide else " " + words(script, 1, 3)
        link = lambda: (more() if rng.random() < 0.45 else pick(["", " no." if wide else ""])) + pick([" ", " ", ": ", " : "])
        parts: list[tuple[str, str | None]] = []
        if rng.random() < 0.4:
            parts.append((words(script, 1, 4) + gap(), None))
        topic = pick(["phone"] * 4 + ["identity"] * 3 + ["house"] * 4 + ["person"] * 6 + ["mail"] * 3 + ["plot", "plot", "code", "code", "price", "price", "size", "route", "street", "firm", "place", "place", "capitals", "bare", "bare", "bare"])
        if topic == "phone":
            first = cue("person", script) + gap() if rng.random() < 0.25 else ""
            parts += [(first + cue("phone", script) + (link() if rng.random() < 0.5 else pick([" ", ": ", gap()])), None), (fill("p"), "PHONE")]
        elif topic == "identity":
            parts += [(cue("identity", script) + link(), None), (fill("i"), "ID_NUMBER")]
        elif topic == "house":
            number = (fill("h"), "ADDRESS")
            road = {"lao": "l", "thai": "m"}.get(script, "r")
            tail = [pick([" ", ", "]) + pick([f"{cue('street', script)}{gap()}{pick([digits(1), digits(2), word(road)])}", f"{word(road).capitalize() if road == 'r' else word(road)} {cue('street', script)}"]) for _ in range(int(rng.integers(0, 3)))]
            tail += [pick([" ", ", "]) + cue("place", script) + gap() + word(road)] if rng.random() < 0.4 or not tail else []
            parts += [(cue("house", script) + (link() if rng.random() < 0.5 else pick([" ", ": ", ", ", gap()])), None), number, ("".join(tail), None)]
        elif topic == "person":
            way = rng.random()
            title = cue("title", script) + pick([" ", " ", ". " if wide else " ", gap()]) if rng.random() < 0.7 else ""
            if script == "han" and rng.random() < 0.6:
                parts += [(cue("person", script) + pick(["", " ", "："]), None), (name(script), "NAME"), (pick(["", " "]) + pick(_AFTER_HAN) + (cue("after name", script) if rng.random() < 0.5 else ""), None)]
            elif way < 0.15 and wide:
                parts = [(name(script), "NAME"), (" " + cue("after name", script), None)]
            else:
                parts += [(cue("person", script) + pick([" ", " ", ": "]) if way < 0.8 or not title else "", None), (title, None), (name(script), "NAME"), (pick([" ", " ", ""]) + cue("after name", script) if rng.random() < 0.4 else "", None)]
                if script in ("lao", "thai") and parts[-1][0][:1] not in ("", " "):
                    parts[-1] = (" " + parts[-1][0], None)
        elif topic == "mail":
            parts += [(pick(["email", "e-mail", "mail", "ອີເມລ", "อีเมล", "thư", "邮件", ""]) + pick([": ", " "]), None), (fill("e"), "EMAIL")] if rng.random() < 0.6 else [(f"{words('latin', 1, 2)} @ {digits(int(rng.integers(1, 4)))} {pick([cue('price', 'latin'), words('latin', 1, 2)])} {words('latin', 1, 2)}", None)]
        elif topic in ("plot", "code"):
            parts += [(cue(topic, script) + link() + fill(pick(["s", "t"] if topic == "plot" else ["c", "c", "t"])), None)]
        elif topic == "price":
            amount = fill("a")
            parts += [(pick([f"{cue('price', script)}{gap()}{amount}", f"{amount} {cue('price', script)}", f"{cue('price', script)}: {amount} {cue('price', script)}", amount]), None)]
        elif topic == "size":
            unit = cue("size", script)
            parts += [(pick([f"{digits(2)} {unit} x {digits(2)} {unit}", f"{unit} {digits(3)} {unit}", f"{digits(1)},{digits(3)} {unit}", f"{cue('street', script)}{gap()}{words(script, 0, 2)} {digits(1)} {unit}", f"{digits(2)} m. {words('latin', 2, 3).capitalize()}"]), None)]
        elif topic == "route":
            parts += [(f"{cue('route', script)}{gap()}{digits(int(rng.integers(1, 3)))} {pick([cue('route', script) + gap() + digits(2), words(script, 1, 2)])}", None)]
        elif topic == "street":
            parts += [(f"{cue('place', script)}{gap()}{words(script, 1, 2)} {cue('street', script)}{gap()}{digits(int(rng.integers(1, 3)))}", None)]
        elif topic == "firm":
            parts += [(pick([f"{name(script)}{gap()}{cue('firm', script).capitalize()}", f"{cue('firm', script).capitalize()}{gap()}{name(script)}", f"{cue('place', script)} {name('latin')} {cue('firm', 'latin').capitalize()}"]), None)]
        elif topic == "place":
            parts += [(pick([f"{cue('place', script).capitalize()}{gap()}{name(script)}", f"{name('latin')} {pick(['District', 'Village', 'Road'])}", f"{cue('place', script)}{gap()}{name(script)}, {cue('place', script).capitalize()}{gap()}{name(script)}"]), None)]
        elif topic == "capitals":
            parts += [(" ".join(w.capitalize() for w in words("latin", 2, 5).split()), None)]
        else:
            # Words in which a title or another cue only happens to stand.
            parts += [(pick([f"{words(script, 1, 3)} {digits(int(rng.integers(1, 5)))} {words(script, 1, 3)}", f"{words(script, 1, 2)}{gap()}{cue(pick(['title', 'person']), script)}{gap()}{cue(pick(list(CUES)), script)} {words(script, 1, 2)}", f"{words(script, 1, 1)}{cue('title', script)}{words(script, 1, 2)} {words(script, 1, 2)}"]), None)]
        if rng.random() < 0.45:
            parts.append((pick([" ", ", "]) + words(script, 1, 5), None))
        text, cases = "", []
        for piece, kind in parts:
            if wide and not text and piece and kind is None:
                piece = piece[:1].upper() + piece[1:]
            if kind:
                cases.append((kind, len(text), len(text) + len(piece)))
            text += piece
        return text, cases

    out = []
    for _ in range(count):
        text, cases, glue = "", [], pick([". ", "\n", " | ", "\n\n"])
        for k in range(int(rng.integers(1, 4))):
            piece, some = sentence()
            text += glue if k else ""
            cases += [(kind, len(text) + start, len(text) + end) for kind, start, end in some]
            text += piece
        out.append((text, cases))
    return out


@lru_cache(maxsize=1)
def trained() -> dict[str, boosting.BoostedTrees]:
    """One model per kind, fitted on generated sentences."""
    rows: dict[str, list] = {k: [] for k in KINDS}
    labels: dict[str, list] = {k: [] for k in KINDS}
    for text, cases in taught_sentences(10_000):
        f = Folded(text)
        # Only a name is proposed with several ends.
        true = {c if c[0] == "NAME" else c[:2] for c in cases}
        for kind, start, end in f.candidates():
            rows[kind].append(f.features(kind, start, end))
            labels[kind].append(((kind, start, end) if kind == "NAME" else (kind, start)) in true)
    return {k: boosting.fit(np.array(rows[k]), np.array(labels[k])) for k in KINDS}


def _chosen(found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Of overlapping spans the most probable, then the longest."""
    taken: list[tuple[str, int, int]] = []
    for _p, kind, start, end in sorted(found, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
        if all(end <= s or start >= e for _, s, e in taken):
            taken.append((kind, start, end))
    return sorted(taken, key=lambda x: x[1])


def spans_of(texts: list[str], models: dict[str, boosting.BoostedTrees]) -> list[list[tuple[str, int, int]]]:
    """Spans ``(kind, start, end)`` in code points of each text as stored."""
    folded = [Folded(t) for t in texts]
    proposed = {k: [] for k in KINDS}
    for n, f in enumerate(folded):
        for kind, start, end in f.candidates():
            proposed[kind].append((n, start, end))
    found: list[list] = [[] for _ in texts]
    for kind, spans in proposed.items():
        if spans:
            p = models[kind].probabilities(np.array([folded[n].features(kind, s, e) for n, s, e in spans]))
            for (n, s, e), q in zip(spans, p):
                if q >= models[kind].threshold:
                    found[n].append((float(q), kind, s, e))
    return [[(k, f.stored(s), f.stored(e - 1) + 1) for k, s, e in _chosen(spans)] for f, spans in zip(folded, found)]


def personal_spans(df: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """``(key, pii_type, span_start, span_end)`` of every place; null and empty texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            keys = b[key].tolist()
            rows = [(k, *s) for k, spans in zip(keys, spans_of(b[text].tolist(), shared.value)) for s in spans]
            yield frame(**{c: [r[i] for r in rows] for i, c in enumerate((key, "pii_type", "span_start", "span_end"))})

    return df.where(f"`{text}` is not null and `{key}` is not null").select(key, text).mapInPandas(run, f"`{key}` {kind}, pii_type string, span_start int, span_end int")


def redacted(df: DataFrame, text: str = "text", to: str = "redacted") -> DataFrame:
    """``df`` with its text in ``to``, every place replaced by ``[KIND]``; null stays null."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.StringType())])

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b[text]]
            out = []
            for t, raw, spans in zip(texts, b[text], spans_of(texts, shared.value)):
                for kind, s, e in reversed(spans):
                    t = f"{t[:s]}[{kind}]{t[e:]}"
                out.append(None if raw is None else t)
            yield b.assign(**{to: out})[schema.names]

    return df.mapInPandas(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys carry the same text, so equal rows are kept once."""
    return personal_spans(table(spark, sf_dir, "records")).selectExpr("key AS record_key", "pii_type", "span_start").distinct()
