"""Evaluation passages inside corpus documents, by template canonicalisation.

1. Texts become canonical tokens: NFKC, case folded, invisible characters dropped, every number, identifier (letters with
   digits) and unit replaced by a typed placeholder whose value is kept as a slot. CJK characters are tokens of their own. Names, words written with a capital
   inside a sentence, have a placeholder too, which stands *beside* the word, as copies may change case; a text that writes many of its words so (titles,
   languages that write nouns so) marks no names by it.
2. Windows of ``WINDOW`` canonical tokens are hashed on both sides, those with names once as they stand and once as templates. A bitmap sized by the
   items' windows lets only promising corpus windows leave the scan; these are hash-joined with the items' windows (Catalyst picks
   the join), and (document, item) pairs that share enough windows become candidates. A window of more than ``HOT_ITEMS`` items is left out for those items that it and
   its like make up a small part of, so stock phrases do not multiply documents by items; other items keep all their windows.
3. A candidate is aligned in the surroundings of its windows: the best local alignment, then the better of a
   second one before or after it in both texts and near it. Slots must correspond one to one in the aligned part; slots
   that contradict the correspondence, and letters in place of a placeholder, count as changed words.
4. Reported are documents in which the stretches cover at least ``least`` of the item's words. Words of a passage count as reproduced where they stand as they are; names
   replaced one to one count for the template, which tells re-parameterised passages.

Defined cases: NULL and empty texts leak nothing; an item shorter than a window is compared as a single window of its own
length; repeated items or documents with the same text are each reported; texts are processed whole, however long.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assaymill.session import settle

WINDOW = 4
SHARE_OF_WINDOWS = 0.08  #: of an item's windows a candidate must share
LEAST_WINDOWS = 2  #: and at least so many
BITMAP_BITS = 20, 28  #: fewest and most bits of the bitmap's index; in between sixteen slots per window
HOT_ITEMS = 64  #: items beyond which a window is hot
HOT_SHARE = 0.3  #: of an item's windows that may be hot and left out
NAMES_MOST = 0.2  #: of the words inside sentences that may be written with a capital, if this is to mark names
NEAR = 90  #: words that may lie between two neighbouring stretches
MATCH, MISS, GAP = 1.0, -0.7, -0.7

#: Units of measure.
UNITS = frozenset(
    "percent nm um µm μm mm cm m km ng ug µg μg mg g kg ml ul µl μl l nanomolar micromolar millimolar molar second seconds minute minutes hour hours day days week weeks "
    "month months year years degree degrees celsius kelvin byte bytes kb mb gb tb dollar dollars euro euros usd eur".split()
)
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
TOKEN = re.compile(
    r"(?P<id>[^\W\d_]+[-_]?\d[^\W_]*)|(?P<num>\d+(?:[.,:]\d+)*)|(?P<unit>[%°€$£])|(?P<cjk>[぀-ヿ㐀-鿿豈-﫿])|(?P<word>(?:(?![぀-ヿ㐀-鿿豈-﫿])[^\W\d_])+)"
)


START = re.compile(r"[.!?:;\n\"“„«»(\[#*|=>-]")  #: between two words: the second one begins a sentence, a line or a title


def canonical(text: str | None) -> tuple[list[str], list[str], list[bool]]:
    """Canonical tokens, the words behind them and which of them are names."""
    text = unicodedata.normalize("NFKC", (text or "").translate(INVISIBLE))
    text = re.sub(r"(?<=[A-Za-z])-\s*\n\s*(?=[A-Za-z])", "", text)
    tokens, words, capital = [], [], []
    inside, end = 0, 0
    for m in TOKEN.finditer(text):
        raw, kind = m.group(), m.lastgroup
        w = raw.casefold()
        words.append(w)
        plain = kind == "word" and w not in UNITS
        tokens.append(w if plain or kind == "cjk" else "<n>" if kind == "num" else "<id>" if kind == "id" else "<u>")
        mid = plain and len(raw) > 1 and end > 0 and not START.search(text[end : m.start()])
        inside += mid
        capital.append(mid and raw[0].isupper() and raw[1:].islower())
        end = m.end()
    if sum(capital) > NAMES_MOST * inside:
        capital = [False] * len(tokens)
    return tokens, words, capital


@lru_cache(maxsize=200_000)
def _token_hash(t: str) -> int:
    return xxhash.xxh64_intdigest(t)


def window_hashes(tokens: list[str], w: int = WINDOW) -> np.ndarray:
    """Signed 64-bit hashes of all windows of ``w`` tokens; none for a shorter text."""
    if len(tokens) < w or not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter((_token_hash(t) for t in tokens), np.uint64, len(tokens))
    out = np.full(len(h) - w + 1, w, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(w):
            out = (out ^ h[k : len(h) - w + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def all_windows(tokens: list[str], names: list[bool], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows as they stand and, where they hold a name, as templates."""
    h = window_hashes(tokens, w)
    at = np.arange(len(h), dtype=np.int32)
    if not len(h) or not any(names):
        return h, at
    named = np.convolve(np.array(names, np.int32), np.ones(w, np.int32), "valid") > 0
    t = window_hashes(["<name>" if x else t for t, x in zip(tokens, names)], w)
    return np.concatenate([h, t[named]]), np.concatenate([at, at[named]])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hs, ps, ns, ws = [], [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens, _, names = canonical(t)
            w = min(WINDOW, len(tokens))
            h, at = all_windows(tokens, names, w)
            ws += [w] * len(h)
            ids += [i] * len(h)
            hs.append(h)
            ps.append(at)
            ns += [len(tokens) - w + 1] * len(h)
        flat = lambda xs, k: pa.array(np.concatenate(xs) if xs else [], k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), flat(hs, pa.int64()), flat(ps, pa.int32()), pa.array(ns, pa.int32()), pa.array(ws, pa.int32())], ["item_id", "h", "ipos", "n_windows", "w"])


def bitmap_bits(n_windows: int) -> int:
    return max(BITMAP_BITS[0], min(BITMAP_BITS[1], math.ceil(math.log2(16 * max(n_windows, 1)))))


def _bitmap(windows: DataFrame, width: int) -> np.ndarray:
    """Bits of the windows' slots: at most 2 ** (BITMAP_BITS[1] - 3) bytes, whatever the number of items."""
    slots = windows.select(F.shiftrightunsigned("h", 64 - width).alias("s")).distinct()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width, bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (width - 3), np.uint8)
    for row in slots.coalesce(8).mapInArrow(fold, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _doc_hits(bits, width: int, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for b in batches:
            ids, texts, hits, at = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens, _, names = canonical(t)
                own, place = [], []
                for w in lengths:
                    h, where = all_windows(tokens, names, w)
                    s = (h.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
                    p = np.flatnonzero(known[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1) if len(h) else np.zeros(0, np.int64)
                    own.append(h[p])
                    place.append(where[p])
                if any(len(p) for p in place):
                    ids.append(i)
                    texts.append(t)
                    hits.append(np.concatenate(own))
                    at.append(np.concatenate(place))
            cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hits])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x) if x else np.zeros(0, d), k)) for x, d, k in ((hits, np.int64, pa.int64()), (at, np.int32, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), *lists], ["doc_id", "text", "hs", "ps"])

    return run


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal tokens, or a name for a name."""
    return (x[..., 0] == y[..., 0]) | (x[..., 1] == y[..., 1])


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Score and aligned positions (i, j), matches and substitutions, of the best local alignment of rows of (word, name) codes; -1 and -2 match nothing."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, []
    h = np.zeros((n + 1, m + 1))
    steps = np.arange(m + 1) * -GAP
    for i in range(1, n + 1):
        s = np.where(alike(a[i - 1], b), MATCH, MISS)
        row = np.maximum(h[i - 1, :-1] + s, h[i - 1, 1:] + GAP)
        row = np.concatenate([[0.0], np.maximum(row, 0)])
        h[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(h.argmax(), h.shape)
    score, path = float(h[i, j]), []
    while h[i, j] > 1e-9:
        s = MATCH if alike(a[i - 1], b[j - 1]) else MISS
        if abs(h[i, j] - h[i - 1, j - 1] - s) < 1e-9:
            path.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j] - GAP) < 1e-9:
            i -= 1
        else:
            j -= 1
    return score, path[::-1]


def stretches(a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int]]]:
    """The best stretch and, if any, the better neighbour of it."""
    score, first = local_alignment(a, b)
    if not first:
        return []
    (i0, j0), (i1, j1) = first[0], first[-1]
    before = local_alignment(a[:i0], b[max(0, j0 - NEAR - i0 - 10) : j0])
    after = local_alignment(a[i1 + 1 :], b[j1 + 1 : j1 + 1 + NEAR + len(a) - i1 + 10])
    lo = max(0, j0 - NEAR - i0 - 10)
    if max(before[0], after[0]) < 3:
        return [first]
    if before[0] >= after[0]:
        return [[(i, j + lo) for i, j in before[1]], first]
    return [first, [(i + i1 + 1, j + j1 + 1) for i, j in after[1]]]


Text = tuple[list[str], list[str], list[bool]]


def coverage(item: Text, doc: Text, at: list[int]) -> list[tuple[float, float, float]]:
    """(share of the item's words in the stretches, share of them reproduced, share reproduced or renamed one to one) at each of the places around window hits ``at``."""
    (it, iw, im), (dt, dw, dm) = item, doc
    if not it:
        return []
    ids: dict[str, int] = {}
    a = np.array([(ids.setdefault(t, len(ids)), 1 if x else -2) for t, x in zip(it, im)])
    reach = len(it) + NEAR + 10
    spans: list[list[int]] = []
    for p in sorted(set(at)):
        if spans and p - reach <= spans[-1][1]:
            spans[-1][1] = p + reach
        else:
            spans.append([p - reach, p + reach])
    out = []
    for lo, hi in spans:
        lo = max(0, lo)
        b = np.array([(ids.get(t, -1), 1 if x else -1) for t, x in zip(dt[lo:hi], dm[lo:hi])])
        found = stretches(a, b)
        pairs = [(i, j + lo) for s in found for i, j in s]
        same = consistent(it, iw, dt, dw, pairs)
        renamed = renames(it, dt, [(i, j) for i, j in pairs if im[i] and dm[j]])
        span = sum(s[-1][0] - s[0][0] + 1 for s in found)
        out.append((span / len(it), same / len(it), (same + renamed) / len(it)))
    return out


def renames(it: list[str], dt: list[str], pairs: list[tuple[int, int]]) -> int:
    """Aligned names that differ, where each name of the item stands for one name of the document and the other way round."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for i, j in pairs:
        there.setdefault(it[i], dt[j])
        back.setdefault(dt[j], it[i])
    return sum(it[i] != dt[j] and there[it[i]] == dt[j] and back[dt[j]] == it[i] for i, j in pairs)


def consistent(it: list[str], iw: list[str], dt: list[str], dw: list[str], pairs: list[tuple[int, int]]) -> int:
    """Aligned equal tokens, less those whose slots break a one-to-one correspondence of values."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    n = 0
    for i, j in pairs:
        if it[i] != dt[j]:
            continue
        if it[i][0] == "<":
            k, r = (it[i], iw[i]), (it[i], dw[j])
            if there.setdefault(k, dw[j]) != dw[j] or back.setdefault(r, iw[i]) != iw[i]:
                continue
        n += 1
    return n


FOUND = "doc_id bigint, item_id string, covered double, reproduced double, template double"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cached = lru_cache(maxsize=4096)(canonical)
    last: tuple[str | None, Text] = (None, ([], [], []))
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for doc_id, text, item_id, item_text, at in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "item_id", "item_text", "at"))):
            if last[0] != text:
                last = (text, canonical(text))
            for found in coverage(cached(item_text), last[1], at):
                for col, x in zip(cols, (doc_id, item_id, *found)):
                    col.append(x)
        kinds = [pa.int64(), pa.string(), *[pa.float64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "covered", "reproduced", "template"])


def joined_windows(windows: DataFrame) -> DataFrame:
    """The windows by which items are sought: hot ones are left out where they are at most HOT_SHARE of an item's, so that enough others remain in any leak."""
    hot = windows.groupBy("h").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") > HOT_ITEMS).select("h", F.lit(True).alias("hot"))
    marked = windows.join(hot, "h", "left")
    share = marked.groupBy("item_id").agg((F.count("hot") / F.count(F.lit(1))).alias("share"))
    return marked.join(share, "item_id").filter(F.col("hot").isNull() | (F.col("share") > HOT_SHARE)).select("item_id", "h", "ipos", "n_windows", "w")


def scored_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, reproduced, template) for every place of every candidate pair."""
    spark = docs.sparkSession
    told = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item_text")).filter("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    windows = settle(joined_windows(settle(told.mapInArrow(_item_windows, "item_id string, h bigint, ipos int, n_windows int, w int"))))
    width = bitmap_bits(windows.count())
    bits = spark.sparkContext.broadcast(_bitmap(windows, width))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lengths = sorted(r["w"] for r in windows.select("w").distinct().collect())  # at most WINDOW values
    hit = settle(texts.mapInArrow(_doc_hits(bits, width, lengths), "doc_id bigint, text string, hs array<bigint>, ps array<int>"))
    places = hit.select("doc_id", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("doc_id", F.col("x.hs").alias("h"), F.col("x.ps").alias("dpos"))
    met = places.join(windows, "h").groupBy("doc_id", "item_id").agg(
        F.countDistinct("ipos").alias("n"), F.first("n_windows").alias("of"), F.collect_set("dpos").alias("at")
    )
    wanted = met.filter(F.col("n") >= F.least("of", F.greatest(F.lit(LEAST_WINDOWS), F.ceil(F.col("of") * SHARE_OF_WINDOWS)))).select("doc_id", "item_id", "at")
    pairs = wanted.join(hit.select("doc_id", "text"), "doc_id").join(told, "item_id")
    return pairs.mapInArrow(_verify, FOUND)


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.55, same: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered): at one place, stretches cover at least ``least`` of the item's words, and at least ``same`` of them are
    reproduced as they stand (the others being the few words changed); sentences of similar build reach neither."""
    s = scored_leaks(docs, items)
    return s.filter((F.round("covered", 6) >= least) & (F.round("reproduced", 6) >= same)).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def reparameterised(docs: DataFrame, items: DataFrame, least: float = 0.55, same: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, renamed): places that reproduce an item as a template, with names changed one to one, beyond what they reproduce word for word."""
    s = scored_leaks(docs, items).filter((F.round("covered", 6) >= least) & (F.round("template", 6) >= same) & (F.col("template") > F.col("reproduced")))
    return s.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max(F.col("template") - F.col("reproduced")).alias("renamed"))
