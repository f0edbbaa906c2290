"""Problem 1: freely typed place names mapped to the entries of a reference list.

Values and names are folded to one spelling per script: Lao without tone marks
(Thai letters go to the Lao letters they stand for first) and Latin without the
differences between romanisations.  A multi-pattern automaton over the folded
names and aliases of villages and districts finds embedded mentions, the
longest not overlapping ones win.  Values without a mention go to token-set
similarity over letter pairs; the most similar entry is taken where it is
similar enough and the next one clearly less so.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from uuid import uuid4

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions.frames import frame
from tamarind.session import table

UNMATCHED = "UNMATCHED"

# Lao letters for Thai letters.
THAI_LETTERS = dict(zip("กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ", "ກຂຂຄຄຄງຈຊຊຊຊຍດຕຖທທນດຕຖທທນບປຜຝພຟພມຍລລວສສສຫລອຮ"))
THAI_SIGNS = dict(zip("ะัาำิีึืุูเแโใไๅๆ", "ະັາຳິີຶືຸູເແໂໄໄາໆ"))
#: Thai words that Lao spells otherwise.
THAI_WORDS = {"สวรรค์": "ສະຫວັນ", "สวรค์": "ສະຫວັນ", "สวรรรค์": "ສະຫວັນ", "สวรรค": "ສະຫວັນ", "ไชย": "ໄຊ", "ชัย": "ໄຊ", "แร่": "ແຮ່", "ตาล": "ຕານ", "กลาง": "ກາງ", "จันทร์": "ຈັນ", "จันทน์": "ຈັນ", "เหล็ก": "ເຫຼັກ", "ใหญ่": "ໃຫຍ່", "ราช": "ລາດ", "สวน": "ສວນ", "บุญ": "ບຸນ", "เพชร": "ເພັດ"}
_THAI = {ord(a): b for a, b in (THAI_LETTERS | THAI_SIGNS).items()} | {ord(c): None for c in "็ฺ่้๊๋"}
_LAO_FOLDS = [(re.compile(a), b) for a, b in (("[່-໌ໍ]", ""), ("ຫ(?=[ນມລວງຍຣຼ])", ""), ("[ຼຣ]", "ລ"), ("ໜ", "ນ"), ("ໝ", "ມ"), ("ໃ", "ໄ"), ("ເເ", "ແ"), ("ຢ", "ຍ"), ("ິ", "ີ"), ("ຶ", "ື"), ("ຸ", "ູ"), ("ັວ", "ົວ"))]
_LATIN_FOLDS = [
    (re.compile(a), b)
    for a, b in (
        ("([^aeiou])\\1+", r"\1"), ("ngh", "ng"), ("x|sh", "s"), ("w", "v"), ("ph", "p"), ("th", "t"), ("kh", "k"), ("chh?", "c"), ("ny", "y"), ("ei?ou|euu|oeu", "u"),
        ("(?:ou|eu|u|ue)e?a", "ua"), ("oo|ou|eu|ue", "u"), ("ae", "e"), ("e[ovu](?![a-z]*[aeiou]u)", "eo"), ("a[oy]y?u?(?=[^aeiou]|$)", lambda m: "ao" if m[0][1] == "o" else "ai"), ("ay", "ai"), ("(.)\\1+", r"\1"), ("r", "l"),
    )
]
#: Similarity that an entry needs: in the district that was named, without one; and how much the next entry must be behind.
LEAST, SURE, APART = 0.4, 0.5, 0.03
#: Slips of typing that an entry may be away in the district that was named; without one it is a single slip.
SLIPS = 2
#: Distinct values that a task resolves.
VALUES_PER_TASK = 50_000
#: Most names that are broadcast: some 100 MB; a longer list is refused, not cut.
MOST_NAMES = 1_000_000


def fold_latin(s: str) -> str:
    """Latin letters in one romanisation; all else is left out."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("đ", "d")) if "a" <= c <= "z")
    for pattern, to in _LATIN_FOLDS:
        s = pattern.sub(to, s)
    return s


def fold_lao(s: str) -> str:
    """Lao letters without tone marks and short-vowel signs, Thai taken to Lao; all else is left out."""
    s = re.sub("ํ([่-๋]*)า", r"\1ำ", re.sub("ໍ([່-໋]*)າ", r"\1ຳ", unicodedata.normalize("NFC", s)))
    if any("ก" <= c <= "๛" for c in s):
        for a, b in THAI_WORDS.items():
            s = s.replace(a, b)
        s = re.sub("[ก-ฮ][ิุ]?์", "", s).translate(_THAI)
    s = "".join(c for c in s if "ກ" <= c <= "ໟ")
    for pattern, to in _LAO_FOLDS:
        s = pattern.sub(to, s)
    return s


def _tokens(s: str) -> frozenset[str]:
    """The token set of a name: its pairs of letters next to each other and next but one, numbered where they come again; begin and end marked."""
    s, seen, out = f"^{s}$", Counter(), []
    for t in [*(s[i : i + 2] for i in range(len(s) - 1)), *(f"{s[i]}_{s[i + 2]}" for i in range(len(s) - 2))]:
        seen[t] += 1
        out.append(f"{t}{seen[t]}")
    return frozenset(out)


def slips(a: str, b: str, most: int) -> int:
    """Least number of insertions, deletions, replacements and swaps of neighbours; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return min(row[-1], most + 1)


class SimilarNames:
    """Names by token-set similarity: twice the common letter pairs over all (Dice).

    A name that reaches ``LEAST`` shares one of the rarest pairs that it cannot do without, so only
    the names filed under these are compared, however long the list.
    """

    def __init__(self, names):
        self.tokens = {n: _tokens(n) for n in names}
        self.count = Counter(p for pairs in self.tokens.values() for p in pairs)
        self.filed = defaultdict(list)
        for n, pairs in self.tokens.items():
            for p in self._rarest(pairs):
                self.filed[p].append(n)

    def _rarest(self, pairs: frozenset[str]) -> list[str]:
        needed = -int(-LEAST * len(pairs) / (2 - LEAST) // 1)
        return sorted(pairs, key=lambda p: (self.count[p], p))[: len(pairs) - needed + 1]

    def above(self, name: str, least: float) -> list[tuple[float, str]]:
        """``(similarity, name)`` of all names of at least that similarity, the greatest first."""
        own = _tokens(name)
        met = {n for p in self._rarest(own) for n in self.filed.get(p, ())}
        scored = ((2 * len(own & self.tokens[n]) / (len(own) + len(self.tokens[n])), n) for n in met)
        return sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], x[1]))


# Words around a name, in folded form of their script; they say that a village or a district follows or came before.
VILLAGE_WORDS = "ban baan baang village villages muban moo b. ບ້ານ ບ. บ้าน หมู่บ้าน บ. ໝູ່ບ້ານ bản làng 村".split()
DISTRICT_WORDS = "muang meuang mueang district town city huyện ເມືອງ ມ. เมือง อำเภอ ม. quận".split()
LOOSE_WORDS = "road way ทางไป ทาง ທາງໄປ ທາງ near close to in at the area around zone ใกล้ แถว ตัวเมือง ตัว ย่าน ใน ที่ อยู่ ໃກ້ ແຖວ ຕົວເມືອງ ຕົວ ຢູ່ ເຂດ ໃນ ທີ່ gần tại thành phố près de du".split()
_AFFIX = re.compile(
    r"(?i)(?<![^\W\d_])(?:" + "|".join(re.escape(w) for w in VILLAGE_WORDS + DISTRICT_WORDS + LOOSE_WORDS if w[0].isascii() or w[0] in "lh") + r")(?![^\W\d_])|" + "|".join(re.escape(w) for w in sorted(VILLAGE_WORDS + DISTRICT_WORDS + LOOSE_WORDS, key=len, reverse=True) if not w[0].isascii())
)


class PlaceIndex:
    """Automaton and similarity index over the names of villages and districts.

    ``villages`` and ``districts`` are ``(code, parent, names)``; a name may be borne by several.  Names
    of one or two letters are found where they are all that stands between other words.
    """

    def __init__(self, villages, districts):
        self.parent = {code: parent for code, parent, _ in villages}
        self.names: dict[str, dict[str, set[str]]] = {"lao": defaultdict(set), "latin": defaultdict(set)}
        self.districts: dict[str, dict[str, set[str]]] = {"lao": defaultdict(set), "latin": defaultdict(set)}
        for into, rows in ((self.names, villages), (self.districts, districts)):
            for code, _parent, names in rows:
                for n in names:
                    for script, fold in (("lao", fold_lao), ("latin", fold_latin)):
                        if f := fold(n or ""):
                            into[script][f].add(code)
        self.automata, self.near, self.near_district = {}, {}, {}
        for script in ("lao", "latin"):
            a = ahocorasick.Automaton()
            for kind, source in (("D", self.districts), ("V", self.names)):
                for n in source[script]:
                    a.add_word(n, (a.get(n, ("", 0))[0] + kind, len(n)))
            if len(a):
                a.make_automaton()
            self.automata[script] = a
            self.near[script], self.near_district[script] = SimilarNames(self.names[script]), SimilarNames(self.districts[script])

    def mentions(self, folded: str, script: str) -> list[tuple[int, int, str]]:
        """Longest mentions that don't overlap: ``(start, end, kinds)``."""
        a = self.automata[script]
        if not len(a) or not folded:
            return []
        found = sorted(((end + 1 - n, end + 1, kinds) for end, (kinds, n) in a.iter(folded) if n > 2 or n == len(folded)), key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        return sorted(taken)

    def _similar(self, name: str, script: str, within: set[str]) -> set[str]:
        """Codes of the most similar entry, in a district if one was named; none where another comes close."""
        # An exact check follows the similarity: no more slips of typing than SLIPS, one without a district.
        most = SLIPS if within else 1
        found = [(d, self.names[script][n]) for d, n in self.near[script].above(name, LEAST) if slips(name, n, most) <= most]
        if within:
            found = [(d, c) for d, codes in found if (c := {x for x in codes if self.parent[x] in within})]
        if not found or found[0][0] < (LEAST if within else SURE):
            return set()
        rival = next((d for d, codes in found if codes != found[0][1]), 0.0)
        return found[0][1] if found[0][0] - rival >= APART else set()

    def resolve(self, value: str | None) -> str:
        """Code of the one village that a value means, else ``UNMATCHED``."""
        if not value:
            return UNMATCHED
        text = unicodedata.normalize("NFKC", value)
        districts: set[str] = set()
        left: list[tuple[str, str]] = []
        exact: list[set[str]] = []
        for script, fold in (("lao", fold_lao), ("latin", fold_latin)):
            # A district stands after its word, in brackets or behind a comma; names are looked for piece by piece first.
            pieces = [p for p in _AFFIX.split(_mark(text)) if fold(p)]
            whole = [fold(p) for p in pieces]
            for piece in whole:
                taken, rest, at = self.mentions(piece, script), "", 0
                for start, end, kinds in taken:
                    rest += piece[at:start]
                    at = end
                    name = piece[start:end]
                    if "V" in kinds:
                        exact.append(self.names[script][name])
                    else:
                        districts |= self.districts[script][name]
                rest += piece[at:]
                if len(rest) >= 3:
                    left.append((rest, script))
        codes = set().union(*exact) if exact else set()
        if not codes:
            for rest, script in sorted(left, key=lambda r: -len(r[0])):
                if not districts and (near := self.near_district[script].above(rest, SURE)):
                    districts |= self.districts[script][near[0][1]]
                    continue
                if codes := self._similar(rest, script, districts) or (self._similar(rest, script, set()) if districts else set()):
                    break
        if len(codes) > 1 and districts:
            codes = {c for c in codes if self.parent[c] in districts}
        elif len(codes) == 1 and districts and not any(self.parent[c] in districts for c in codes):
            return UNMATCHED
        return next(iter(codes)) if len(codes) == 1 else UNMATCHED


_BREAKS = re.compile(r"[,;()\[\]/|•·\n]+")


def _mark(text: str) -> str:
    return _BREAKS.sub(" near ", text)


def map_places(values: DataFrame, villages: DataFrame, districts: DataFrame, *, value: str = "value_text") -> DataFrame:
    """Adds ``village_code`` to distinct values.  The lists are fixed reference tables and are broadcast.

    Null and empty values, values that name nothing listed and names that two villages bear without
    the district being said give ``UNMATCHED``.
    """
    named = F.concat(F.array("name_lo", "name_en"), F.coalesce("name_variants", F.array().cast("array<string>")))
    v = [(r[0], r[1], [n for n in r[2] if n]) for r in villages.where("code is not null").select("code", "district_code", named).orderBy("code").collect()]
    d = [(r[0], None, [n for n in r[1] if n]) for r in districts.where("code is not null").select("code", named).orderBy("code").collect()]
    if sum(len(r[2]) for r in v) + sum(len(r[2]) for r in d) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names; map the values list by list")
    shared, mark = values.sparkSession.sparkContext.broadcast((v, d)), uuid4().hex

    def run(batches):
        index = _index(mark, shared)
        for b in batches:
            yield frame(**{value: b[value]}, village_code=[index.resolve(t) for t in b[value]])

    return values.select(value).mapInPandas(run, f"`{value}` string, village_code string")


_INDEXES: dict[str, PlaceIndex] = {}


def _index(mark: str, shared) -> PlaceIndex:
    """The index of a list, built once in each worker."""
    if mark not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[mark] = PlaceIndex(*shared.value)
    return _INDEXES[mark]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per LOCATION_TEXT claim; every distinct value is resolved once."""
    claims = table(spark, sf_dir, "claims").where("field = 'LOCATION_TEXT' and claim_id is not null").groupBy("claim_id").agg(F.min("value_text").alias("value_text"))
    distinct = claims.where("value_text is not null").select("value_text").distinct()
    # The values are few bytes but long work each: spread by count, not by size; a task has at most some VALUES_PER_TASK.
    distinct = distinct.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-distinct.count() // VALUES_PER_TASK)))
    mapped = map_places(distinct, table(spark, sf_dir, "villages"), table(spark, sf_dir, "districts"))
    return claims.join(mapped, "value_text", "left").select("claim_id", F.coalesce("village_code", F.lit(UNMATCHED)).alias("village_code"))
