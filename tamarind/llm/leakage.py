"""Problem 9: passages of held-out items inside a corpus.

Each shard of the corpus gets an FM-index over its letters, vowel and tone
signs and digits.  The items are cut into blocks that any passage of the
required length must hold whole; backward search finds the blocks, sampled
suffix positions locate them, and the items are laid on the text there and
compared exactly, once for each place an item may begin at.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions.frames import frame
from tamarind.llm.fmindex import MAX_SHARD, FMIndex, classes
from tamarind.session import table

#: Least number of consecutive signs that makes a leak.
PASSAGE = 50
#: Blocks of an item: any PASSAGE consecutive signs hold one block of BLOCK signs at a multiple of STRIDE.
BLOCK, STRIDE = 25, 26
#: Signs of a shard; a longer single text makes shards that overlap by the longest item.
SHARD = 1 << 20
#: Items, and signs of their texts, broadcast in one pass; more items are searched in further passes over the corpus.
ITEMS_PER_PASS, SIGNS_PER_PASS = 20_000, 32_000_000
#: Hits of a phrase widened at once.
AT_ONCE = 1 << 20
#: Makes positions before a shard's begin whole numbers from 0: more than an item has signs.
AWAY = 1 << 38


class _Signs(dict):
    def __missing__(self, code: int):
        ch = chr(code)
        to = ch if ch in "ຳำ" else unicodedata.normalize("NFKC", ch).casefold()
        self[code] = to = "".join(c for c in to if unicodedata.category(c)[0] in "LMN")
        return to


_signs = _Signs()
_FIXES = [(re.compile(a), b) for a, b in ((r"ໍ([່-໌]*)າ", r"\1ຳ"), (r"ຳ([່-໌]+)", r"\1ຳ"), (r"ํ([่-๋]*)า", r"\1ำ"), (r"ำ([่-๋]+)", r"\1ำ"))]
_MARKS = re.compile("[ັິ-ຼ່-໎]{2,}|[ัิ-ฺ็-๎]{2,}")


def signs_of(text: str) -> str:
    """Letters, vowel and tone signs and digits in one case, width and composition."""
    s = unicodedata.normalize("NFC", text.translate(_signs))
    if s.isascii():
        return s
    s = s.replace("ເເ", "ແ").replace("เเ", "แ").replace("ຫນ", "ໜ").replace("ຫມ", "ໝ")
    if "ໍ" in s or "ຳ" in s or "ํ" in s or "ำ" in s:
        for pattern, to in _FIXES:
            s = pattern.sub(to, s)
    return _MARKS.sub(lambda m: "".join(sorted(m[0])), s)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class ItemBlocks:
    """The distinct blocks of a set of items, and where in the items each stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        texts = [_codes(signs_of(t)) for _, t in items]
        self.longest = max([len(t) for t in texts], default=0)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.signs = np.concatenate([*texts, np.zeros(0, dtype=np.uint32)])
        places: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            if len(t) >= PASSAGE:
                for o in range(0, len(t) - BLOCK + 1, STRIDE):
                    places.setdefault(classes(t[o : o + BLOCK]).astype(np.uint8).tobytes(), []).append((k, o))
        self.phrases = np.array([np.frombuffer(b, dtype=np.uint8) for b in places], dtype=np.int64).reshape(-1, BLOCK)
        self.count = np.array([len(p) for p in places.values()], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.places = np.array([x for p in places.values() for x in p], dtype=np.int64).reshape(-1, 2)

    def passages(self, text: np.ndarray) -> np.ndarray:
        """Rows ``(item, start, end)`` of passages in a shard's signs, in which 0 parts the texts."""
        index = FMIndex(np.where(text == 0, 0, classes(text)))
        low, high = index.search(self.phrases)
        hit = np.repeat(np.arange(len(low)), high - low)
        if not len(hit):
            return np.zeros((0, 3), dtype=np.int64)
        rows = np.arange(len(hit)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
        # Diagonals (item, position of its first sign), made in parts of bounded size; a repeated sign hits often, but on few of them.
        parts: list[np.ndarray] = []
        made = np.cumsum(self.count[hit])
        for at in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(made // AT_ONCE)) + 1):
            n = self.count[hit[at]]
            which = np.repeat(self.first[hit[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, offset = self.places[which].T
            parts.append(np.unique((item << 40) + (np.repeat(index.locate(rows[at]), n) - offset + AWAY)))
            if len(parts) > 64:
                parts = [np.unique(np.concatenate(parts))]
        found = []
        for diagonal in np.unique(np.concatenate(parts)).tolist():
            item, shift = diagonal >> 40, (diagonal & (1 << 40) - 1) - AWAY
            # The item is laid on the text there; runs of equal signs are the passages.
            first, last = max(0, -shift), min(int(self.at[item + 1] - self.at[item]), len(text) - shift)
            same = np.zeros(last - first + 2, dtype=np.int8)
            same[1:-1] = text[first + shift : last + shift] == self.signs[self.at[item] + first : self.at[item] + last]
            edges = np.flatnonzero(np.diff(same))
            for left, right in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if right - left >= PASSAGE:
                    found.append((item, first + shift + left, first + shift + right))
        if not found:
            return np.zeros((0, 3), dtype=np.int64)
        # Passages of an item that overlap or touch are one.
        found.sort()
        merged = [list(found[0])]
        for item, left, right in found[1:]:
            if item == merged[-1][0] and left <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], right)
            else:
                merged.append([item, left, right])
        return np.array(merged, dtype=np.int64)


def _source_span(text: str, signs: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that hold its signs ``start:end``; the whole text where they can't be told apart."""
    at, places = 0, []
    for m in re.finditer(r"(?s).[̀-ͯັິ-ຼ່-໎ัิ-ฺ็-๎]*(?:(?<=[ໍ່-໌])າ|(?<=[ํ่-๋])า)?", text):
        k = len(signs_of(m[0]))
        places.append((at, at + k, m.start(), m.end()))
        at += k
    if at != len(signs):
        return 0, len(text)
    inside = [p for p in places if p[1] > start and p[0] < end and p[1] > p[0]]
    return inside[0][2], inside[-1][3]


def _shards(texts: list[str], overlap: int):
    """Lists of ``(document, from)`` with the signs of a shard, documents parted and ended by 0."""
    part, size = [], 0
    for k, s in enumerate(texts):
        whole = _codes(s)
        if len(whole) < PASSAGE:
            continue
        step = SHARD - overlap
        for at in range(0, max(1, len(whole) - overlap), step):
            piece = whole[at : at + SHARD]
            if part and size + len(piece) + 1 > SHARD:
                yield part
                part, size = [], 0
            part.append((k, at, piece))
            size += len(piece) + 1
    if part:
        yield part


def leaked_passages(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``(key, item_id, span_start, span_end)``: merged spans of each item's passages in each document.

    Spans are code points of the text as stored.  Shards are built where the documents lie, without a
    shuffle.  Null and short texts have no spans; a repeated item or document gives its rows once per
    key; items under ``PASSAGE`` signs cannot leak; no items give no rows.
    """
    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, item_id long, span_start int, span_end int"
    rows = items.where(f"`{item}` is not null and text is not null").select(F.col(item).cast("long"), "text").orderBy(item)

    def passes():
        part, size = [], 0
        for r in rows.toLocalIterator():
            if part and (len(part) >= ITEMS_PER_PASS or size + len(r[1]) > SIGNS_PER_PASS):
                yield part
                part, size = [], 0
            part.append((r[0], r[1]))
            size += len(r[1])
        yield part

    out = None
    for block in passes():
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            blocks = ItemBlocks(shared.value)
            overlap = min(blocks.longest + 1, SHARD // 2)
            for b in batches:
                keys, texts = b[key].to_numpy(), b[text].tolist()
                signs = [signs_of(t) for t in texts]
                found = []
                for shard in _shards(signs, overlap) if len(blocks.phrases) else ():
                    joined = np.zeros(sum(len(p) + 1 for *_, p in shard), dtype=np.uint32)
                    begins, at = [], 0
                    for *_, piece in shard:
                        begins.append(at)
                        joined[at : at + len(piece)] = piece
                        at += len(piece) + 1
                    for i, left, right in blocks.passages(joined):
                        n = int(np.searchsorted(begins, left, side="right")) - 1
                        k, begin, _ = shard[n]
                        found.append((k, int(blocks.ids[i]), int(left) - begins[n] + begin, int(right) - begins[n] + begin))
                merged = []
                for k, i, left, right in sorted(found):
                    if merged and merged[-1][:2] == [k, i] and left <= merged[-1][3]:
                        merged[-1][3] = max(merged[-1][3], right)
                    else:
                        merged.append([k, i, left, right])
                spans = [_source_span(texts[k], signs[k], l, r) for k, _, l, r in merged]
                yield frame(**{key: [keys[m[0]] for m in merged]}, item_id=[m[1] for m in merged], span_start=[s[0] for s in spans], span_end=[s[1] for s in spans])

        made = documents.where(f"`{text}` is not null and `{key}` is not null").select(key, text).mapInPandas(search, schema)
        out = made if out is None else out.unionByName(made)
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


assert MAX_SHARD >= SHARD
