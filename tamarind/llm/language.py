"""Problem 4: the language of documents and of the segments of mixed documents.

A sparse multinomial logistic regression over TF-IDF character n-grams of
sentences, trained by follow-the-regularised-leader with elastic-net penalties
and calibrated by a temperature.  The sentences of a text are labelled together:
the best path weighs each sentence's probabilities, by its letters, against the
price of changing the language.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions.frames import frame
from tamarind.llm.lookalike import look_form
from tamarind.session import table

LANGUAGES = ("lo", "th", "en", "vi", "fr", "zh")
# Usual code forms of the languages.
CODES = {"lo": "lo lao", "th": "th tha", "en": "en eng", "vi": "vi vie", "fr": "fr fra fre", "zh": "zh zho chi cmn"}
_CODE = {c: lang for lang, codes in CODES.items() for c in codes.split()}
#: Rows on which the classifier is fitted, drawn by a hash of their key; all else covers every row.
TRAINING_ROWS = 5_000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
#: Letters and signs besides contact details that a text needs.
LEAST_LETTERS = 12
CHANGE = 3.0  # price of a change of language, in nats
FULL_WEIGHT = 16  # letters from which a sentence counts in full

_CONTACT = re.compile(r"(?i)[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+|https?://\S+|www\.\S+|\b[\w-]+\.(?:com|la|net|org|example)\b\S*|#[^\s#]+|(?<!\w)@\w+|\b(?:line|whatsapp|wechat|zalo|viber|telegram)(?: ?id)?\s*[:：]?\s*[\w.@-]*\d[\w.@-]*|\b[A-Z]{2}[ -]?[0-9A-Z]*\d[0-9A-Z]*\b")
_SPLIT = re.compile(r"\n+|\s*\|\s*|(?<=[.!?…])(?<![\s(.,][A-Za-zກ-ຮก-ฮ]\.)\s+|(?<=[。！？])")
_LETTERS = re.compile(r"[^\W\d_]|[ັ-ູົຼ່-ໍัิ-ฺ็-๎]")
_PARTED = re.compile("[ໍํ][່-่໋-๋]?[າา]|ຫ[ນມ]")  # one sign each before the folding


def code_of(label: str | None) -> str | None:
    """Language of a label in any usual code form; None for null, empty, ``und``; ``?`` for another language."""
    s = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return None if s in ("", "und") else _CODE.get(s, "?")


_MARKS_OF = re.compile(r"[^\w\s຀-໿฀-๿]|[\d_]")


def sentences_of(text: str) -> list[tuple[str, int]]:
    """Sentences in one form, without contact details, digits and punctuation, and their count of letters."""
    out = []
    for s in _SPLIT.split(_CONTACT.sub(" ", look_form(text))):
        s = " ".join(_MARKS_OF.sub(" ", s).lower().split())
        if s:
            n = len(s) - s.count(" ") if s.isascii() else len(_LETTERS.findall(s)) - len(_PARTED.findall(s))
            out.append((s, n))
    return out


def ngrams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, sentence by sentence, and where each sentence begins."""
    joined = "\n".join(f" {s} " for s in sentences) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    stop = codes == 10
    own = np.concatenate([[0], np.cumsum(stop)[:-1]])
    parts, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    bad = np.zeros(len(codes), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        bad = bad[:k] | stop[n - 1 :]
        good = np.flatnonzero(~bad)
        parts.append(((h[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int32))
        owners.append(own[good])
    buckets, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(sentences)))


#: Temperature at which the sentences of a text are labelled together; the confidences have the calibrated one.
PATH_TEMPERATURE = 0.22


@dataclass
class LanguageModel:
    """IDF per bucket, weights per bucket and language, intercepts, temperature."""

    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def log_probabilities(self, sentences: list[str]) -> np.ndarray:
        if not sentences:
            return np.zeros((0, len(LANGUAGES)))
        out = np.empty((len(sentences), len(LANGUAGES)), dtype=np.float64)
        for at in range(0, len(sentences), 4000):
            buckets, begins = ngrams(sentences[at : at + 4000])
            idf = self.idf[buckets]
            norm = np.sqrt(np.add.reduceat(idf * idf, begins))
            scores = np.add.reduceat(self.weights[buckets] * idf[:, None], begins, axis=0)
            out[at : at + 4000] = scores / np.maximum(norm, 1e-9)[:, None] + self.bias
        out /= self.temperature
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit(rows: list[tuple[str, str]], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, epochs: int = 2) -> LanguageModel:
    """Fit on ``(text, label)`` rows.

    Labels may be wrong: sentences whose label a fit on the other half contradicts are left out of the
    last fit.  The same held-out probabilities set the temperature.
    """
    votes: dict[str, list[int]] = {}
    for text, label in rows:
        if (lang := code_of(label)) in LANGUAGES:
            for s, n in sentences_of(text):
                if n >= 6:
                    votes.setdefault(s, [0] * len(LANGUAGES))[LANGUAGES.index(lang)] += 1
    samples = [(s, v.index(max(v))) for s, v in sorted(votes.items())]  # a repeated sentence teaches once, by the most of its labels
    if not samples:
        return LanguageModel(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)))
    order = np.random.default_rng(7).permutation(len(samples))
    samples = [samples[i] for i in order]
    texts, labels = [s for s, _ in samples], np.array([l for _, l in samples])
    buckets, begins = ngrams(texts)
    ends = np.append(begins[1:], len(buckets))
    rows_of = [np.unique(buckets[b:e], return_counts=True) for b, e in zip(begins, ends)]
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for f, _ in rows_of:
        seen[f] += 1
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    values = []
    for (f, c), b, e in zip(rows_of, begins, ends):
        x = idf[buckets[b:e]]
        values.append(c * idf[f] / max(float(np.sqrt((x * x).sum())), 1e-9))
    k = len(LANGUAGES)
    balance = np.sqrt(len(texts) / (k * np.maximum(np.bincount(labels, minlength=k), 1)))

    def train(rows: np.ndarray) -> LanguageModel:
        z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
        zb, nb = np.zeros(k), np.zeros(k)

        def weight(z, n):
            return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

        for _ in range(epochs):
            for i in rows:
                f, x = rows_of[i][0], values[i]
                zf, nf = z[f], n[f]
                w, wb = weight(zf, nf), -zb / ((beta + np.sqrt(nb)) / alpha + l2)
                s = x @ w + wb
                p = np.exp(s - s.max())
                p /= p.sum()
                p[labels[i]] -= 1
                p *= balance[labels[i]]
                g = x[:, None] * p
                g2 = g * g
                z[f] = zf + g - (np.sqrt(nf + g2) - np.sqrt(nf)) / alpha * w
                n[f] = nf + g2
                nb2 = nb + p * p
                zb += p - (np.sqrt(nb2) - np.sqrt(nb)) / alpha * wb
                nb = nb2
        return LanguageModel(idf, weight(z, n).astype(np.float32), -zb / ((beta + np.sqrt(nb)) / alpha + l2))

    # Each half is judged by a model of the other half, so that no wrong label vouches for itself.
    logp = np.empty((len(texts), k))
    for half in (0, 1):
        judged = np.flatnonzero(np.arange(len(texts)) % 2 == half)
        judge = train(np.flatnonzero(np.arange(len(texts)) % 2 != half))
        logp[judged] = judge.log_probabilities([texts[i] for i in judged])
    keep = np.flatnonzero(logp[np.arange(len(texts)), labels] > math.log(0.2))
    model = train(keep if len(keep) else np.arange(len(texts)))
    # All held-out rows set the temperature, those with a contradicted label too: a label is taken to be wrong as often as they are.
    wrong = 1 - len(keep) / len(texts)

    def loss(t):
        s = logp / t
        s = s - s.max(1, keepdims=True)
        p = np.exp(s[np.arange(len(texts)), labels]) / np.exp(s).sum(1)
        return -float(np.log((1 - wrong) * p + wrong / k).mean())

    model.temperature = float(min(np.geomspace(0.1, 5, 40), key=loss))
    return model


def sharpened(logp: np.ndarray, by: float) -> np.ndarray:
    """Logarithms of probabilities at a temperature that is lower by a factor."""
    s = logp * by
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def segments(parts: list[tuple[str, int]], logp: np.ndarray, sharpen: float = 1.0) -> list[tuple[str, float]]:
    """Languages of the segments of one text, in order, each with its calibrated confidence; the best path takes sharpened ones."""
    weights = [min(1.0, n / FULL_WEIGHT) if n >= 3 else 0.0 for _, n in parts]
    if not any(weights):  # only very short sentences: all of them count
        weights = [min(1.0, n / FULL_WEIGHT) for _, n in parts]
    if not any(weights):
        return []
    best = logp.argmax(axis=1)
    sure = {int(b) for b, w in zip(best, weights) if w}
    if len(sure) == 1:
        path = [sure.pop()] * len(parts)
    else:
        score, back = np.zeros(len(LANGUAGES)), []
        for w, row in zip(weights, sharpened(logp, sharpen)):
            moved = score.max() - CHANGE
            back.append(np.where(score >= moved, np.arange(len(LANGUAGES)), score.argmax()))
            score = np.maximum(score, moved) + w * np.maximum(row, -12.0)
        path = [int(score.argmax())]
        for b in reversed(back[1:]):
            path.append(int(b[path[-1]]))
        path.reverse()
    out: list[list] = []
    for k, w, row in zip(path, weights, logp):
        if w:
            if out and out[-1][0] == k:
                out[-1][1] += w * math.exp(row[k])
                out[-1][2] += w
            else:
                out.append([k, w * math.exp(row[k]), w])
    return [(LANGUAGES[k], p / w) for k, p, w in out]


def languages_of(records: DataFrame, model: LanguageModel, key: str = "key", text: str = "text", label: str = "lang") -> DataFrame:
    """``(record_key, segment_no, lang, confidence, label)`` of every segment of every text.

    Null texts and texts under ``LEAST_LETTERS`` letters besides contact details have no segments.
    Repeated rows are each labelled.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            keys, labels, own, flat = [], [], [], []
            for k, t, l in zip(b["record_key"], b["text"], b["label"]):
                parts = sentences_of(t)
                if sum(n for _, n in parts) >= LEAST_LETTERS:
                    keys.append(k), labels.append(l), own.append(parts), flat.extend(s for s, _ in parts)
            distinct = {s: i for i, s in enumerate(dict.fromkeys(flat))}
            logp = model.log_probabilities(list(distinct))
            rows = []
            for k, l, parts in zip(keys, labels, own):
                for no, (lang, p) in enumerate(segments(parts, logp[[distinct[s] for s, _ in parts]], model.temperature / PATH_TEMPERATURE)):
                    rows.append((k, no, lang, p, l))
            columns = ("record_key", "segment_no", "lang", "confidence", "label")
            yield frame(**{c: [r[i] for r in rows] for i, c in enumerate(columns)})

    chosen = records.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null and record_key is not null")
    return chosen.mapInPandas(run, "record_key string, segment_no int, lang string, confidence double, label string")


def training_rows(records: DataFrame, text: str = "text", label: str = "lang", key: str = "key") -> list[tuple[str, str]]:
    """At most ``TRAINING_ROWS`` labelled rows, drawn by a hash of the key."""
    codes = [c for cs in CODES.values() for c in cs.split()]
    known = records.where(F.col(text).isNotNull() & F.lower(F.split(F.col(label), "[-_]")[0]).isin(codes)).select(F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(key).alias("h"))
    # Some more rows than wanted by their hash, copies as one, so that what is gathered does not grow with the table.
    some = known.where(F.pmod("h", F.lit(max(1, known.count()))) < TRAINING_ROWS * 5 // 4).distinct()
    return [(r[0], r[1]) for r in some.orderBy("h", "t", "l").limit(TRAINING_ROWS).collect()]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the texts whose label is missing or names no language of the text, or that mix languages."""
    records = table(spark, sf_dir, "records")
    found = languages_of(records, fit(training_rows(records))).select("record_key", "segment_no", "lang", "label").distinct()
    short = F.lower(F.split(F.trim("label"), "[-_]")[0])
    to_lang = F.create_map(*(F.lit(x) for c, lang in _CODE.items() for x in (c, lang)))
    per = found.groupBy("record_key", "label").agg(F.collect_list(F.struct("segment_no", "lang")).alias("s"))
    named = F.try_element_at(to_lang, short)
    wrong = F.col("label").isNull() | short.isin("", "und") | named.isNull() | ~F.array_contains(F.col("s.lang"), named)
    return per.where(wrong | (F.size("s") > 1)).select("record_key", F.explode("s").alias("s")).select("record_key", "s.segment_no", "s.lang").distinct()
