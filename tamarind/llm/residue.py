"""Problem 10: template residue, filler, error pages and script notices.

Unfilled fields are found by one small grammar per delimiter.  A bracketed field
must name something to be filled in, unlike labels such as "[SOLD]".  Fields do
not count inside code, in sentences that speak of blanks, templates or programs,
and in texts with several words about programs.  Filler
and messages count by density: they must stand in place of content, that is,
what the text holds beside them must be less than they are.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre
from re._parser import parse

from pyspark.sql import DataFrame, SparkSession

from tamarind.functions.frames import frame
from tamarind.session import table

_NAME = r"[^\W\d][\w .:\-]{0,40}"
#: One grammar for each delimiter.
FIELDS = {
    "mustache": rf"\{{\{{\{{?\s*[#/>&^]?\s*{_NAME}(?:\s*\|[^{{}}\n]{{0,40}})?\s*\}}?\}}\}}",
    "block": r"\{%-?\s*\w[^%\n]{0,60}-?%\}",
    "server": r"<%[=\-]?\s*[^%\n]{1,60}?\s*-?%>",
    "php": r"<\?(?:=|php\b)[^?\n]{1,60}\?>",
    "dollar": rf"\$\{{\s*{_NAME}\}}",
    "hash": rf"#\{{\s*{_NAME}\}}",
    "brace": r"(?<![\w{$#%\\])\{(?:\d{1,2}|[^\W\d][\w.\-]{0,40})\}(?!\})",
    "at": r"@@\w{2,40}@@",
    "double bracket": rf"\[\[\s*{_NAME}\s*\]\]",
    "percent": r"(?<![\w%])%[^\W\d]\w{2,40}%(?!\w)",
    "printf": r"(?<![\w%])%(?:\(\w+\))?[sd](?![\w%])",
    "underscore": r"(?<!\w)__[^\W\d_][\w]{1,40}?__(?!\w)",
    "merge tag": r"\*\|[^|\n]{1,40}\|\*",
    "guillemet": r"<<\s*[^\W\d][\w ]{1,40}>>",
}
_FIELD = re.compile("|".join(f"(?:{p})" for p in FIELDS.values()))
_FIELD_SIGNS = re.compile(r"[{@\[%<_*]")
#: Bracketed or angled words are a field where they ask to be filled in.
_ASKING = re.compile(
    r"(?i)^(?:your|insert|enter|add|type|put|fill|choose|select|company|client|customer|first|last|full)\b|\b(?:here|to be (?:added|filled|announced|confirmed)|tbd|tba|placeholder)$|_"
    r"|^(?:ໃສ່|ຕື່ມ|ພິມ|ປ້ອນ)|ບ່ອນນີ້|^(?:ใส่|กรอก|เติม|ระบุ)|ที่นี่$|^(?:ชื่อ|ราคา|เบอร์|ที่อยู่|พื้นที่|วันที่)|^(?:ຊື່|ລາຄາ|ເບີ|ທີ່ຢູ່|ເນື້ອທີ່|ວັນທີ)"
    r"|^(?:nhập|điền|chèn|tên|giá|địa chỉ|số điện thoại)|^(?:insérer|saisir|votre|nom|prix|adresse|à compléter|ajouter)\b|^(?:请|填写|输入|插入|姓名|价格|地址|电话)"
    r"|^(?:name|price|address|phone|email|date|title|village|district|province|location|area|currency|agent|description|amount|number|city|contact)(?: name| number| here)?$"
)
_BRACKET = re.compile(r"(?<!\[)\[([^\[\]\n]{2,60})\](?!\]|\()|<([^\W\d][^<>\n=/\"']{2,60})>")
#: A sentence that speaks of blanks and fields does not leave one unfilled.
_SPEAKS_OF = re.compile(
    r"(?i)\b(?:blanks?|fill (?:them|it|in|out)|by hand|placeholder|template|syntax|variable|replace[sd]? with|form has)\b|ຟອມ|ແບບຟອມ|ດ້ວຍມື|ຊ່ອງ|แบบฟอร์ม|ช่อง|ด้วยมือ|กรอกด้วย|表格|手写|空格|填表|formulaire|à la main|mẫu đơn|biểu mẫu|đơn có|ô trống|bằng tay|điền tay"
)
#: Words of writing about programs and templates; a text with several of them explains fields, and leaves none unfilled.
_PROGRAMS = re.compile(
    r"(?i)\b(?:python|javascript|typescript|java|ruby|php|bash|shell|jinja2?|mustache|handlebars|django|liquid|f-?strings?|template engine|templating|syntax|variables?|functions?|methods?|constructors?|dunder|interpolat\w+|substitut\w+|placeholders?|tutorials?|snippets?|"
    r"compilers?|source code|render(?:s|ed|ing)?|parsers?|config(?:uration)? files?|environment variables?|command line|regex\w*|delimiters?|escap(?:e|es|ed|ing)|format strings?|printf|markdown|base path|repository|arguments?|parameters?|literals?)\b|ຕົວແປ|ตัวแปร|变量|语法|模板|biến|cú pháp|variable"
)
_NAMED_AS = re.compile(r"(?i)\b(?:use|using|write|writing|written as|type|typing|called|named|expression|token|marker|tag)\s+[\"'“‘(]?$")
_NAMED_BY = re.compile(r"(?i)^[\"'”’)]?\s+(?:methods?|functions?|variables?|placeholders?|tags?|tokens?|attributes?|filters?|class|modules?|arguments?|parameters?|expressions?|directives?|markers?|notation|syntax|is (?:replaced|substituted|expanded|filled|rendered))\b")
_CODE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre)\b.*?(?:</\1>|\Z)|`[^`\n]{1,200}`|^(?: {4}|\t)\S[^\n]*$", re.M)
_SENTENCE = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")

# The words of the customary dummy Latin.
DUMMY_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim laborum"
).split()
_DUMMY = re.compile(r"(?i)\b(?:" + "|".join(w for w in DUMMY_WORDS if len(w) > 3) + r"|sed|sit|non)\b")
_FILLER = re.compile(
    r"(?i)texte d['’]exemple|ຂໍ້ຄວາມຕົວຢ່າງ|ข้อความตัวอย่าง|nội dung mẫu|văn bản mẫu|示例(?:文本|文字|内容)|(?:占位|样本)(?:文本|文字|内容)|placeholder (?:paragraph|text)|(?:sample|dummy|filler|example) (?:text|content)(?: for layout(?: only)?)?|(?:description|content|text) goes here|(?:insert|your|enter|add) (?:description|text|content)(?: here)?|ໃສ່(?:ເນື້ອໃນ|ຂໍ້ຄວາມ)ບ່ອນນີ້|ใส่(?:เนื้อหา|ข้อความ)ที่นี่"
    r"|texte (?:à venir|de remplissage)|(?:asdf ?|qwer(?:ty)? ?|zxcv ?|hjkl ?){1,9}|(?<!\w)x{4,}(?!\w)|(?<!\w)(?:test ?){3,}|(?:blah?[ ,.]*){3,}|(?:(?:ทดสอบ|ທົດສອບ|测试|thử nghiệm|essai)[ ,.]*){3,}|to be (?:added|written) later|coming soon|内容待补充"
)

# Messages in place of content, by language: what is asked or reported, in the words of the page itself.
_SCRIPT = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b|no ?script|ສະຄຣິບ|ສະຄິບ|สคริปต์|สคริปท์|脚本)"
_SCRIPT_ASKS = (
    r"(?:enabl|activ|habilit|aktiv|turn(?:ed)? (?:it |them )?(?:on|off)|allow|requir|support|disabl|switch(?:ed)? (?:on|off)|blocked|need|must|nécessit|désactiv|activez|bật|tắt|cần|ເປີດ|ປິດ|ຕ້ອງການ|เปิด|ปิด|ต้อง|启用|开启|禁用|关闭|需要|支持)"
)
MESSAGES = [
    # cookies and checks; scripts are asked for by two words of one sentence, see _SCRIPTS
    r"cookies? .{0,30}(?:must be|to go on|to continue|enabled|allowed)|checking your browser|verify(?:ing)? (?:that )?you are (?:a )?human|unusual traffic|are you a robot|captcha",
    # errors
    r"\b(?:error|http|code|status|erreur|fehler|errore|lỗi|mã)\s*:?\s*(?:4\d\d|5\d\d)\b|\b(?:40[0-9]|410|429|50[0-4])\b[ \-:.|]*(?:not found|bad gateway|forbidden|error|gateway|service|internal|unauthori[sz]ed|too many|page|gone|-)|\"error\"\s*:|错误代码|รหัสข้อผิดพลาด|ລະຫັດຂໍ້ຜິດພາດ",
    r"(?:page|file|url|object|site)\b.{0,30}(?:not found|could(?:n't| not) be found|cannot be (?:shown|displayed|found)|does(?:n't| not) exist|not available)|internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|maintenance window|too many requests|error establishing|traceback\b|fatal(?: error)?:|undefined (?:index|variable)|exception in|stack trace|database connection|upstream timed|connection (?:refused|reset|timed out)|something went wrong|an? (?:unexpected |unknown )?error (?:has )?occurred|temporarily down|under maintenance",
    r"ລະບົບຂັດຂ້ອງ|ເກີດຂໍ້ຜິດພາດ|ບໍ່ພົບໜ້າ|ບໍ່ພົບຫນ້າ|ລອງໃໝ່ພາຍຫຼັງ|ບໍ່ສາມາດສະແດງ|ระบบขัดข้อง|เกิดข้อผิดพลาด|ไม่พบหน้า|ลองใหม่ภายหลัง|ไม่สามารถแสดง|页面不存在|找不到(?:该|您|页面)|无法显示|网络异常|服务器错误|系统(?:繁忙|错误)|稍后(?:再试|重试)|une erreur est survenue|page (?:demandée )?(?:est )?introuvable|réessayer plus tard|trang .{0,12}không tồn tại|không tìm thấy trang|lỗi máy chủ|thử lại sau|đã xảy ra lỗi|seite nicht gefunden|página no encontrada|pagina non trovata",
    # log-in, permission and blocks
    r"(?:log|sign) ?in (?:to|first|required)|please (?:log|sign) in|you must (?:log|sign|be a member|be logged)|session .{0,25}(?:expired|timed out)|access (?:is )?denied|permission to (?:view|access)|forbidden|account (?:has been )?(?:suspended|blocked|disabled)|your (?:ip|account|access) .{0,25}blocked|members only",
    r"ກະລຸນາເຂົ້າສູ່ລະບົບ|ເຂົ້າສູ່ລະບົບກ່ອນ|ກະລຸນາລັອກອິນ|ບໍ່ມີສິດ(?:ເຂົ້າ|ເບິ່ງ)|กรุณาเข้าสู่ระบบ|เข้าสู่ระบบ(?:ก่อน|อีกครั้ง|เพื่อ)|เซสชัน.{0,6}หมดอายุ|ไม่มีสิทธิ์|ถูกระงับ|请(?:先)?登录|登录后|无权(?:访问|查看)|访问被拒绝|会话.{0,4}过期|veuillez vous connecter|connectez-vous|accès (?:refusé|interdit)|session (?:a )?expiré|vui lòng đăng nhập|đăng nhập để|phiên .{0,16}hết hạn|không có quyền",
    # removal
    r"(?:content|listing|post|page|advert|ad)\b.{0,40}(?:isn't available|is(?: no longer| not) available|has (?:expired|been (?:removed|deleted|taken down))|was (?:removed|deleted|taken down)|no longer exists)|removed by (?:the )?(?:owner|author|admin|moderator)",
    r"ອາດຖືກລຶບ|ຖືກລຶບ(?:ແລ້ວ|ອອກ)|ໝົດອາຍຸແລ້ວ|ถูกลบ|หมดอายุแล้ว|已(?:被)?删除|已(?:过期|下架|失效)|a été (?:supprimée?|retirée?)|n'est plus disponible|n'existe plus|đã bị xóa|đã hết hạn|không còn tồn tại",
]
_MESSAGE = re.compile("(?i)" + "|".join(f"(?:{m})" for m in MESSAGES))
_SCRIPTS, _ASKS = re.compile(f"(?i){_SCRIPT}"), re.compile(f"(?i){_SCRIPT_ASKS}")
#: Letters that a message has at most; more in one unbroken line is content beside it.
LONGEST_MESSAGE = 130
#: Letters that may follow a message as the rest of it ("Try again later.").
MESSAGE_REST = 70


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a regular expression outside all groups and classes."""
    made, depth, at, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            k = pattern.index("]", k + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            made.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*made, pattern[at:]]


def _folded(text: str) -> str:
    """Small letters as regular expressions without regard to case take them."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return text.lower()


def _literals(items) -> tuple[set[str] | None, set[str] | None]:
    """Of a parsed expression: all strings it matches, where they are few; literals of which each match holds one."""

    def better(a, b):
        rank = lambda x: (0, 0) if not x or "" in x else (min(map(len, x)), -len(x))
        return a if rank(a) >= rank(b) else b

    run, needed, whole = {""}, None, True
    for op, value in items:
        all_of = some = None
        if op is sre.LITERAL:
            all_of = {_folded(chr(value))}
        elif op is sre.IN and all(o is sre.LITERAL or o is sre.RANGE and v[1] - v[0] < 10 for o, v in value):
            all_of = {_folded(chr(c)) for o, v in value for c in (range(v[0], v[1] + 1) if o is sre.RANGE else (v,))}
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            all_of = {""}
        elif op is sre.SUBPATTERN:
            all_of, some = _literals(value[-1])
        elif op is sre.BRANCH:
            each = [_literals(b) for b in value[1]]
            all_of = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
            some = set().union(*(n for _, n in each)) if all(n for _, n in each) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            e, n = _literals(inner)
            if least == 0:
                all_of = e | {""} if e is not None and most == 1 else None
            else:
                all_of = e if most == 1 else None
                some = {x * least for x in e} if e and len(e) == 1 else n
        if all_of is not None and len(run) * len(all_of) <= 64:
            run = {a + b for a in run for b in all_of}
        else:
            needed, whole = better(better(needed, run), better(some, all_of)), False
            run = {""}
    needed = better(needed, run)
    return run if whole else None, needed if needed and "" not in needed else None


# What a text must hold for an alternative to match is derived from the alternative, so that no match is passed over: one
# automaton finds which alternatives a text may hold, and only those are searched for.
_PHRASES = [a for m in MESSAGES for a in _alternatives(m)]
#: A code with its number may as well be that of a plot, a price or a room: it counts beside one of the words or where it stands alone.
_CODES = {k for k, a in enumerate(_PHRASES) if a in _alternatives(MESSAGES[1])[:2]}
MESSAGE_WORDS = (
    "script js cookie error http browser captcha robot human traffic found gateway unavailable available maintenance requests traceback fatal undefined exception stack database upstream connection wrong log_in login sign_in signin session denied permission "
    "forbidden suspended blocked members exist removed expired deleted taken_down unauthori cannot "
    "ສະຄຣິບ ສະຄິບ ລະບົບ ຜິດພາດ ບໍ່ພົບ ບໍ່ສາມາດ ລຶບ ໝົດອາຍຸ ບໍ່ມີສິດ ລັອກອິນ ລອງໃໝ່ สคริปต์ สคริปท์ ระบบ ผิดพลาด ไม่พบ ไม่สามารถ ลบ หมดอายุ สิทธิ์ ระงับ ลองใหม่ "
    "页面 错误 登录 删除 过期 下架 失效 脚本 网络 显示 访问 系统 服务器 找不到 稍后 会话 erreur introuvable connect accès supprimé retiré disponible existe expiré réessayer lỗi trang đăng_nhập xóa hết_hạn quyền thử_lại tồn_tại"
).split()
_SINGLE = [re.compile(f"(?i){a}") for a in _PHRASES]


def _words_automaton():
    import ahocorasick

    words: dict[str, set] = {}
    expressions = [(k, a) for k, a in enumerate(_PHRASES)] + [("F", a) for a in _alternatives(_FILLER.pattern.removeprefix("(?i)"))] + [("S", _SCRIPT)]
    for mark, expression in expressions:
        held = _literals(parse(expression, re.I))[1]
        if held is None:
            raise ValueError(f"no literal in {expression}")
        for w in held:
            words.setdefault(w, set()).add(mark)
    for w in {*(w for w in DUMMY_WORDS if len(w) > 3), "sed", "sit", "non"}:
        words.setdefault(w, set()).add("D")
    for w in MESSAGE_WORDS:
        words.setdefault(w.replace("_", " "), set()).add("M")
    made = ahocorasick.Automaton()
    for w, marks in words.items():
        made.add_word(w, (frozenset(marks), w))
    made.make_automaton()
    return made


_WORDS = _words_automaton()


@lru_cache(4096)
def _any_of(phrases: tuple[int, ...]) -> re.Pattern:
    return re.compile("(?i)" + ("|".join(f"(?:{_PHRASES[k]})" for k in phrases) or r"(?!)"))


# Somebody telling of a message, not the message: by who tells, by reporting in the past, by when it was, by what followed.
_TELLER = re.compile(r"(?i)\b(?:i|i'm|i've|my|me|he|she|his|her)\b|ຂ້ອຍ|ຂ້າພະເຈົ້າ|ເລີຍ|ເພາະ|ຍ້ອນ|ผม|ฉัน|เลย|เพราะ|我|所以|因为|\b(?:je|j'ai|mon|ma|mes|il|elle)\b|\btôi\b")
_TELLS = [
    re.compile(r"(?i)\b(?:we|our|us|they|their|members|owner|broker|agent|seller|buyer|neighbou?r|office|nous|notre|ils|elles|chúng ta|họ)\b|ພວກເຮົາ|ເຂົາເຈົ້າ|เรา|พวกเขา|咱们|他们"),
    re.compile(r"(?i)\b(?:showed|shown|said|saw|kept|keeps|got|gave|asked|told|complained|reported|returned|appeared|came|threw|read|went|tried|called|phoned|rang|waited|took|affichait|montrait|disait|a affiché|hiện ra|báo)\b"),
    re.compile(r"(?i)\b(?:yesterday|last (?:night|week|month|year)|(?:for|in|after) (?:\d+|a|an|one|two|three|several|some|many) (?:minutes?|hours?|days?|weeks?|months?)|(?:this|that) (?:morning|evening|week)|when|while|whenever|hier|la semaine|pendant|hôm qua|tuần trước|khi)\b|ເມື່ອວານ|ມື້ວານ|ອາທິດແລ້ວ|ตอน|เมื่อวาน|สัปดาห์|昨天|上周|时候"),
    re.compile(r"(?i)\b(?:so|because|which is why|that is why|whether|why|instead|therefore|but|donc|alors|parce|nên|vì|nhưng)\b"),
]
#: A site that speaks of itself.
_SITE = re.compile(r"(?i)\bwe(?:'re| are)? (?:noticed|detected|sorry|could(?:n't| not)|can(?:'t|not)|have|were unable)\b[^,.;]*|\bon our (?:side|end)\b")


def _tells(sentence: str, message: re.Pattern) -> bool:
    """Whether the words beside the message tell of it."""
    beside = _SITE.sub(" ", message.sub(" ", sentence))
    return _TELLER.search(beside) is not None or sum(p.search(beside) is not None for p in _TELLS) >= 2


_NAVIGATION = re.compile(r"(?i)^(?:[^|\n]{1,30}\|){1,6}[^|\n]{1,30}$|^©.{0,60}$|^(?:nginx|apache)\b.{0,20}$|^(?:home|back|ກັບ|ກັບໄປ|กลับ(?:ไป)?หน้าแรก|返回|retour|quay lại|trang chủ|ref|ray|incident|host)\b.{0,40}$")


def _letters(s: str) -> int:
    return sum(map(str.isalpha, s))


def unfilled_field(text: str) -> str | None:
    """A field left unfilled outside code, in a text and a sentence that do not speak of fields; else None."""
    if not _FIELD_SIGNS.search(text):
        return None
    plain = _CODE.sub(lambda m: "\n" * m[0].count("\n"), text) if "`" in text or "~~~" in text or "<pre" in text or "<code" in text or "\n    " in text or "\n\t" in text else text
    fields = list(_FIELD.finditer(plain)) + [m for m in _BRACKET.finditer(plain) if _ASKING.search((m[1] or m[2]).strip())]
    if not fields or len({w.lower() for w in _PROGRAMS.findall(_FIELD.sub(" ", plain))}) >= 4:
        return None
    for m in fields:
        start = max(plain.rfind(c, 0, m.start()) for c in "\n.!?。") + 1
        stops = [i for i in (plain.find(c, m.end()) for c in "\n.!?。") if i >= 0]
        before, after = plain[start : m.start()], plain[m.end() : min(stops, default=len(plain))]
        said = _FIELD.sub(" ", before + " " + after)
        if not (_SPEAKS_OF.search(said) or _PROGRAMS.search(said) or _NAMED_AS.search(before) or _NAMED_BY.search(after)):
            return m[0]
    return None


def filler(text: str) -> bool:
    """Dummy Latin or filler phrases that make a run of their own."""
    return _dummy_latin(text) or _filler_phrases(text)


def _dummy_latin(text: str) -> bool:
    dummy = _DUMMY.findall(text)
    if len(dummy) >= 6 and len({w.lower() for w in dummy}) >= 4:
        if any(len(s.split()) >= 3 and len(_DUMMY.findall(s)) >= 0.6 * len(s.split()) for s in _SENTENCE.split(text) if s) or len(dummy) >= 0.4 * len(text.split()):
            return True
    return False


def _filler_phrases(text: str) -> bool:
    found = [m[0] for m in _FILLER.finditer(text)]
    if not found:
        return False
    if sum(map(len, found)) >= 24 and len(found) >= 2:
        return True
    return any(_letters(_FILLER.sub("", s)) <= 3 for s in _SENTENCE.split(text) if _FILLER.search(s)) or sum(map(len, found)) >= 0.3 * len(text)


def _says_one_thing(text: str) -> bool:
    """A phrase of one to eight words over and over: short ones five times on end, longer ones three times."""
    words = [w.strip(".,;!?。") for w in text.split()]
    pairs = list(zip(words, words[1:]))
    if len(pairs) - len(set(pairs)) < 4:
        return False
    for k in range(1, 9):
        run = 0
        for a, b in zip(words, words[k:]):
            run = run + 1 if a == b and not a.isdigit() else 0
            if run >= (4 * k if k < 3 else 2 * k):
                return True
    return False


def message_instead(text: str, message: re.Pattern = _MESSAGE) -> bool:
    """An error, log-in, removal or block message or a script notice that outweighs the content beside it."""
    told = said = rest = 0
    parts = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
    for k, s in enumerate(parts):
        n = _letters(s)
        if (message.search(s) or _SCRIPTS.search(s) and _ASKS.search(s)):
            if _tells(s, message):
                told += n
            else:
                said += min(max(n, 4), LONGEST_MESSAGE)
                rest += max(0, n - LONGEST_MESSAGE)
        elif not _NAVIGATION.match(s) and not (k == 0 and len(parts) > 1 and n <= 60):
            rest += n
    return said > 0 and (said >= rest + told or told == 0 and rest <= MESSAGE_REST)


def _code_alone(text: str, phrases: tuple[int, ...]) -> bool:
    """Nothing but codes and lines of navigation."""
    code = _any_of(phrases)
    return all(_letters(code.sub("", s)) <= 3 for s in map(str.strip, _SENTENCE.split(text)) if s and not _NAVIGATION.match(s))


def residue_kind(text: str | None) -> str | None:
    """``field``, ``filler``, ``message`` or None for one text; null and empty texts show nothing."""
    if not text:
        return None
    if unfilled_field(text):
        return "field"
    hits = {found for _, found in _WORDS.iter(_folded(text))}
    marks = set().union(*(m for m, _ in hits))
    # Dummy Latin takes four of its words, a filler phrase one of its literals.
    if sum("D" in m for m, _ in hits) >= 4 and _dummy_latin(text) or "F" in marks and _filler_phrases(text):
        return "filler"
    if _says_one_thing(text):
        return "filler"
    phrases = tuple(k for k in sorted(m for m in marks if isinstance(m, int)) if _SINGLE[k].search(text))
    asks = "S" in marks and _SCRIPTS.search(text) and _ASKS.search(text)
    if not asks and "M" not in marks and _CODES.issuperset(phrases) and not _code_alone(text, phrases):
        return None
    return "message" if (phrases or asks) and message_instead(text, _any_of(phrases)) else None


def template_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, kind)`` of every document that shows residue instead of real content.

    One pass without a shuffle; whole texts are read.  Null and empty texts are none; repeated rows
    are each judged.
    """
    kind = dict(documents.dtypes)[key]

    def judge(batches):
        for b in batches:
            found = [residue_kind(t) for t in b[text]]
            keep = [i for i, k in enumerate(found) if k]
            keys = b[key].tolist()
            yield frame(**{key: [keys[i] for i in keep]}, kind=[found[i] for i in keep])

    return documents.where(f"`{text}` is not null").select(key, text).mapInPandas(judge, f"`{key}` {kind}, kind string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()
