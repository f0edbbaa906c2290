"""Problem 3: one form for text that looks the same but is stored with different characters.

``look_form`` brings a string to one spelling.  Widths, invisible signs, spaces,
hyphens and the composition of accents and of Lao and Thai vowels are folded by
fixed rules.  Look-alike letters are decided per token by script: the script
sets of its characters are intersected, a look-alike counting for its own
script and for those it resembles.  A token whose intersection is empty is
mixed; one that could be written whole in another script is a whole-script
confusable.  Either way the spelling of one consistent script is chosen, Latin
where it can write the whole token, else the script of the letters that have
no look-alike.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions.frames import frame
from tamarind.session import cut, table

# Letters that look like a Latin letter, by script.
CYRILLIC_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮүӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwYyl"))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορστυχοϲϳ", "ABEZHIKMNOPTYXayiknopotuxocj"))
ARMENIAN_LOOKS = dict(zip("ՕՍօսհոցզ", "OUouhngq"))
CHEROKEE_LOOKS = dict(zip("ᎪᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᏴᎡᏒᏔ", "ACEHJKLMPSTVWZBRRW"))
COPTIC_LOOKS = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc"))
LISU_LOOKS = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
LOOKS = {"CYRILLIC": CYRILLIC_LOOKS, "GREEK": GREEK_LOOKS, "ARMENIAN": ARMENIAN_LOOKS, "CHEROKEE": CHEROKEE_LOOKS, "COPTIC": COPTIC_LOOKS, "LISU": LISU_LOOKS}
# Latin letters that look like a plain one.
LATIN_LOOKS = dict(zip("ɑɡıȷ", "agij"))
LATIN_OF = {c: l for looks in LOOKS.values() for c, l in looks.items()}
LIKE_LATIN = {script: {l: c for c, l in looks.items()} for script, looks in LOOKS.items()}
# Scripts written together, each of which stands for all of its languages' scripts.
WRITTEN_WITH = {"CJK": {"CJK", "JAPANESE", "KOREAN", "BOPOMOFO"}, "HIRAGANA": {"HIRAGANA", "JAPANESE"}, "KATAKANA": {"KATAKANA", "JAPANESE"}, "HANGUL": {"HANGUL", "KOREAN"}, "BOPOMOFO": {"BOPOMOFO"}}
HYPHENS = "‐‑﹣－"
SPECIALS = {"ຳ": "ໍາ", "ำ": "ํา", "ໜ": "ຫນ", "ໝ": "ຫມ", "ເເ": "ແ", "เเ": "แ"}

_FOREIGN = re.compile("[" + "".join(LATIN_OF) + "]")
_TOKEN = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_MARKS = re.compile("[ັິ-ຼ່-໎]{2,}|[ัิ-ฺ็-๎]{2,}")
_TWO_E = re.compile("ເເ|เเ")


class _Table(dict):
    """Character table filled as characters occur: width, spaces, hyphens, invisible signs."""

    def __missing__(self, code: int):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in SPECIALS:
            to = SPECIALS[ch]
        elif ch in LATIN_LOOKS:
            to = LATIN_LOOKS[ch]
        elif ch in HYPHENS:
            to = "-"
        elif kind == "Cf" and ch != "‍" or "︀" <= ch <= "️":
            to = ""
        elif kind == "Zs":
            to = " "
        else:
            tag = unicodedata.decomposition(ch)
            to = unicodedata.normalize("NFKC", ch) if tag.startswith(("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>")) or "ﬀ" <= ch <= "ﬆ" or "Ⅰ" <= ch <= "ⅿ" else ch
        self[code] = to
        return to


_table = _Table()


@lru_cache(maxsize=65536)
def _script(ch: str) -> str | None:
    """The script of a letter by its name; None for marks, signs and digits, which belong to every script."""
    if unicodedata.category(ch)[0] != "L":
        return None
    name = unicodedata.name(ch, "?").split(" ")[0]
    return None if name in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO", "OHM") else name


@lru_cache(maxsize=65536)
def script_sets(token: str) -> tuple[frozenset[str], ...]:
    """Resolved script set of every letter: its own script, those written with it, those in which it has a look-alike; common and inherited signs have none."""
    out = []
    for ch in token:
        own = _script(ch)
        if own is None:
            continue
        sets = {own} | WRITTEN_WITH.get(own, set())
        if own == "LATIN":
            sets |= {s for s, looks in LIKE_LATIN.items() if ch in looks}
        elif ch in LATIN_OF:
            sets |= {"LATIN"} | {s for s, looks in LIKE_LATIN.items() if LATIN_OF[ch] in looks}
        out.append(frozenset(sets))
    return tuple(out) or (frozenset(),)


@lru_cache(maxsize=65536)
def consistent_spelling(token: str) -> str:
    """The token in one script: Latin if all its letters allow, else the script that is left, else as is."""
    shared = frozenset.intersection(*script_sets(token))
    if "LATIN" in shared:
        return "".join(LATIN_OF.get(c, c) for c in token)
    if shared:
        # Of several the one most of its letters are in already.
        own = [_script(c) for c in token]
        script = min(shared, key=lambda x: (-own.count(x), x))
        looks = LIKE_LATIN.get(script, {})
        return "".join(c if _script(c) == script else looks.get(LATIN_OF.get(c, c), c) for c in token)
    return "".join(LATIN_OF.get(c, c) for c in token)


def look_form(text: str) -> str:
    """The one form of all strings that look like ``text``."""
    s = unicodedata.normalize("NFC", text.translate(_table))
    if "‍" in s:  # joins two pictures; anywhere else it is invisible
        s = re.sub("(?<![\U0001f000-\U0001faff☀-➿])‍|‍(?![\U0001f000-\U0001faff☀-➿])", "", s)
    if not s.isascii():
        s = _TWO_E.sub(lambda m: SPECIALS[m[0]], s)
        s = _MARKS.sub(lambda m: "".join(sorted(m[0])), s)
        if _FOREIGN.search(s):
            s = _TOKEN.sub(lambda m: consistent_spelling(m[0]) if _FOREIGN.search(m[0]) else m[0], s)
            s = unicodedata.normalize("NFC", s)
    return s.strip(" ")


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _fold_batches(batches):
    for b in batches:
        texts = b["value"].tolist()
        yield frame(key=b["key"], stored=[_digest(t) for t in texts], look=[_digest(look_form(t)) for t in texts])


def normalised(df: DataFrame, column: str, to: str = "look") -> DataFrame:
    """``df`` with its string ``column`` in one form; null stays null, all other columns stay."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.StringType())])

    def run(batches):
        for b in batches:
            yield b.assign(**{to: [None if t is None else look_form(t) for t in b[column]]})[schema.names]

    return df.mapInPandas(run, schema)


def look_classes(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, stored, look, class_key)`` of the values whose look is stored in more than one form: one row per key and form.

    ``stored`` and ``look`` are digests of 128 bits of the value as stored and in its one form; ``class_key``
    is the least key of the look.  Repeated rows count once; null keys and values are left out.  No texts
    are shuffled, and values of a look meet by partial aggregation only.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key is not null and value is not null")
    folded = rows.mapInPandas(_fold_batches, "key string, stored binary, look binary").distinct()
    mixed = folded.groupBy("look").agg(F.min("stored").alias("one"), F.max("stored").alias("other"), F.min("key").alias("class_key")).where("one <> other").select("look", "class_key")
    return folded.join(mixed, "look").select("key", "stored", "look", "class_key")


def same_look_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key_a, key_b)``, key_a < key_b, of values that are stored differently but look the same.

    The classes of ``look_classes`` written out in pairs, form by form, so that copies of one form never
    meet each other.  A key with several values pairs by each, never with itself.
    """
    members = cut(look_classes(df, key, value).select("key", "stored", "look"))  # only looks with several forms: few rows
    forms = members.select("look", "stored").distinct()
    met = forms.select("look", F.col("stored").alias("one")).join(forms.select("look", F.col("stored").alias("other")), "look").where("one < other")
    a = members.select("look", F.col("stored").alias("one"), F.col("key").alias("a"))
    b = members.select("look", F.col("stored").alias("other"), F.col("key").alias("b"))
    return met.join(a, ["look", "one"]).join(b, ["look", "other"]).where("a <> b").select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text looks like another's that is stored differently: one row per record with its class and the forms in it."""
    classes = look_classes(table(spark, sf_dir, "records"), "key", "text")
    forms = classes.select("class_key", "stored").distinct().groupBy("class_key").agg(F.count("*").alias("forms"))
    return classes.select("key", "class_key").distinct().join(forms, "class_key").select(F.col("key").alias("record_key"), "class_key", "forms")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records")
    texts = same_look_pairs(records, "key", "text").select(F.lit("text").alias("field"), "key_a", "key_b")
    authors = same_look_pairs(records.select("author_hash", "author_name").distinct(), "author_hash", "author_name")
    return texts.unionByName(authors.select(F.lit("author_name").alias("field"), "key_a", "key_b"))
