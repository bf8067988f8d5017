"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming blocks, then exact weighted-shingle similarity.

The passages are a stated query set, run as a whole against every document in one pass without a shuffle: their window
fingerprints are indexed and sent to the executors in blocks of bounded size. Each document is folded, cut into words, fingerprinted,
and looked up; an index is built once per worker process.

The size of a window comes from the item. A passage, or 20 words of it, with some of its words changed, misspelt or left out
still holds a run of untouched words, and its window is the longest run that must be left: six words where two of 20 may
change, fewer for shorter passages (window_of). At least one window of every true case therefore has the passage's own
fingerprint, and blocks of the fingerprint find every window within RADIUS bits. Windows as long as the item itself cannot be served:
two changed words of 20 turn 9 of the 64 bits on average (README), beyond what a block index can guarantee.

Candidates are verified by the weighted share of word shingles that a stretch of the item has in common with the document. The
share asked for is exact for each stretch: all of its weight but the most that the allowed changes can destroy, so no true case
fails it. What passes is aligned word by word for the rule of two words in any twenty.

Defined results: null or empty texts and passages match nothing; a passage under 20 words counts only as a whole, with at most two words
altered (one below eight words, none below four); an end word of a quotation counts as altered if it is a near spelling, else (also
where it is left out) the quotation ends before it; repeated rows give one row; ties do not occur (all matches are reported); extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.text import words
from framewright.operators.skew import spread
from framewright.session import cut_lineage

RADIUS = 3
BLOCKS = 4
STRETCH = 20
EDITS = 2
SHINGLE = 3
#: Fingerprints of one block of items, by which the broadcast is bounded; more items go in more blocks.
MOST_FINGERPRINTS = 400_000
WORDS_TOGETHER = 8_000


def edits_of(length: int) -> int:
    """Words of a passage of so many words that may be altered (in any 20 of a longer one)."""
    return EDITS if length >= 8 else 1 if length >= 4 else 0


def window_of(length: int) -> int:
    """The longest run of words that must stay untouched in a passage of so many words, or in 20 words of a longer one."""
    n = min(length, STRETCH)
    return -(-(n - edits_of(n)) // (edits_of(n) + 1))


def word_bits(vocabulary: list[str]) -> np.ndarray:
    """A row of 64 signs per word, from its hash."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).astype(np.int8) * 2 - 1


def simhashes(codes: np.ndarray, at: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """64-bit SimHash of the windows of words that begin at the given places; a tie of a bit counts as 0."""
    sums = np.zeros((len(at), 64), dtype=np.int8)
    for k in range(window):
        sums += bits[codes[at + k]]
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints by each of BLOCKS blocks of bits: within a radius below the number of blocks one block must agree."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.width = prints, 64 // BLOCKS
        self.blocks = []
        for b in range(BLOCKS):
            v = self.block(prints, b)
            order = np.argsort(v, kind="stable").astype(np.int32)
            self.blocks.append((order, np.searchsorted(v[order], np.arange((1 << self.width) + 1))))

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(query positions, print positions) of all pairs within radius, each once."""
        found_q, found_p = [], []
        for b, (order, start) in enumerate(self.blocks):
            v = self.block(queries, b)
            n = start[v + 1] - start[v]
            if not n.sum():
                continue
            q = np.repeat(np.arange(len(queries)), n)
            inside = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            p = order[start[v][q] + inside]
            ok = np.bitwise_count(self.prints[p] ^ queries[q]) <= radius
            found_q.append(q[ok])
            found_p.append(p[ok].astype(np.int64))
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_p)], axis=1), axis=0)
        return both[:, 0], both[:, 1]


def near_spelling(a: str, b: str) -> bool:
    """Whether one word is the other misspelt: of four letters or more, and at most a third of them (two at most) different."""
    most = min(2, max(len(a), len(b)) // 3)
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= most


def align(item: list[str], doc: list[str]) -> list[tuple[int, int, bool]]:
    """(item position, document position, equal) of the words that meet in a cheapest alignment, equal ones and near spellings; the ends of the document piece are free."""
    n, m = len(item), len(doc)
    cost = np.zeros((n + 1, m + 1), dtype=np.int32)
    cost[:, 0] = np.arange(n + 1)
    d = np.array([hash(x) for x in doc], dtype=np.int64)
    columns = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        sub = cost[i - 1, :-1] + (d != hash(item[i - 1]))
        best = np.minimum(sub, cost[i - 1, 1:] + 1)
        row = np.concatenate([[i], best]).astype(np.int32)
        if i < n:
            row = np.minimum.accumulate(row - columns) + columns
        else:
            row = np.minimum.accumulate(row)
        cost[i] = row
    i, j, out = n, m, []
    while i and j:
        c = cost[i, j]
        if item[i - 1] == doc[j - 1] and cost[i - 1, j - 1] == c:
            out.append((i - 1, j - 1, True))
            i, j = i - 1, j - 1
        elif cost[i - 1, j - 1] + 1 == c and item[i - 1] != doc[j - 1]:
            if near_spelling(item[i - 1], doc[j - 1]):
                out.append((i - 1, j - 1, False))
            i, j = i - 1, j - 1
        elif cost[i - 1, j] + 1 == c:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def faults_between(a: tuple[int, int, bool], b: tuple[int, int, bool]) -> list[int]:
    """Item positions of the faults after the pair a up to the pair b: item words that did not meet, more words in the document, a misspelt b."""
    gap, extra = b[0] - a[0] - 1, b[1] - a[1] - 1
    return [*range(a[0] + 1, b[0]), *[b[0]] * max(0, extra - gap), *([] if b[2] else [b[0]])]


def too_many(faults: list[int], edits: int, stretch: int = STRETCH) -> bool:
    """Whether some stretch of words holds more than `edits` of the faults (ascending positions)."""
    return any(faults[k + edits] - faults[k] < stretch for k in range(len(faults) - edits))


def slides(pairs: list[tuple[int, int, bool]], k: int, item: list[str], step: int) -> list[int]:
    """Item positions beside pair k (step -1: before it, 1: after it), free and of the same word, that its document word could meet as well."""
    i, out = pairs[k][0], []
    if pairs[k][2]:
        stop = pairs[k + step][0] if 0 <= k + step < len(pairs) else -1 if step < 0 else len(item)
        at = i + step
        while at != stop and abs(at - i) <= EDITS:
            if item[at] == item[i]:
                out.append(at)
            at += step
    return out


def longest_stretch(pairs: list[tuple[int, int, bool]], item: list[str], edits: int = EDITS) -> int:
    """Longest run of item words that meet at both ends in which no STRETCH words hold more than `edits` faults.

    Of equal words side by side the alignment may have left out either, so an end may slide over them.
    """
    best = 0
    for s in range(len(pairs)):
        for begin in (*slides(pairs, s, item, -1), pairs[s][0]):
            faults = [] if pairs[s][2] else [begin]
            faults += range(begin + 1, pairs[s][0] + 1)
            if too_many(faults, edits):
                continue
            for e in range(s, len(pairs)):
                if e > s:
                    faults += faults_between(pairs[e - 1], pairs[e])
                    if too_many(faults, edits):
                        break
                best = max(best, pairs[e][0] - begin + 1)
                for end in slides(pairs, e, item, 1):
                    if not too_many([*faults, *range(pairs[e][0], end)], edits):
                        best = max(best, end - begin + 1)
        if best >= len(item) - pairs[s][0] + EDITS:
            break
    return best


def words_held(pairs: list[tuple[int, int, bool]], item: list[str]) -> int:
    """Words of the item that the document holds by the rule: a short passage as a whole, else the longest stretch; 0 if too few."""
    best = longest_stretch(pairs, item, edits_of(len(item)))
    return best if best >= min(STRETCH, len(item)) else 0


class Passage:
    """An item's words, its weighted shingles, and for each stretch the weight that a true case must have in common."""

    def __init__(self, tokens: list[str]) -> None:
        self.words, self.k = tokens, min(SHINGLE, len(tokens))
        self.shingles = [tuple(tokens[i : i + self.k]) for i in range(len(tokens) - self.k + 1)]

    def weigh(self, weight: dict[tuple, float]) -> None:
        n = min(len(self.words), STRETCH)
        self.m = n - self.k + 1
        self.w = np.array([weight[s] for s in self.shingles])
        # One altered word destroys at most the k shingles that hold it.
        kills = np.convolve(self.w, np.ones(self.k))
        edits = edits_of(n)
        self.need = np.empty(len(self.w) - self.m + 1)
        for s in range(len(self.need)):
            worst = np.sort(kills[s : s + n])[::-1][:edits].sum()
            self.need[s] = self.w[s : s + self.m].sum() - worst - 1e-9

    def similar(self, doc: list[str]) -> bool:
        """Whether some stretch shares as much weight of shingles with the piece of the document as every true case must."""
        have = {tuple(doc[i : i + self.k]) for i in range(len(doc) - self.k + 1)}
        hit = np.array([s in have for s in self.shingles])
        return bool((np.convolve(self.w * hit, np.ones(self.m), "valid") >= self.need).any())


class PassageIndex:
    """All that one worker needs to look documents up: folded passages, their window prints by size of the window, and shingle weights."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(item_id, Passage(w)) for item_id, passage in items if (w := words(passage))]
        spread_of = Counter(s for _, p in self.items for s in set(p.shingles))
        weight = {s: math.log(1 + len(self.items) / n) for s, n in spread_of.items()}
        self.code: dict[str, int] = {}
        by_window: dict[int, list[int]] = defaultdict(list)
        for i, (_, p) in enumerate(self.items):
            p.weigh(weight)
            for w in p.words:
                self.code.setdefault(w, len(self.code))
            by_window[window_of(len(p.words))].append(i)
        self.bits = word_bits(list(self.code)) if self.code else np.zeros((0, 64), np.int8)
        self.by_window: dict[int, tuple[HammingIndex, np.ndarray, np.ndarray]] = {}
        for window, members in by_window.items():
            prints, owner, place = [], [], []
            for i in members:
                codes = np.array([self.code[w] for w in self.items[i][1].words])
                at = np.arange(len(codes) - window + 1)
                prints.append(simhashes(codes, at, self.bits, window))
                owner += [i] * len(at)
                place += at.tolist()
            self.by_window[window] = HammingIndex(np.concatenate(prints)), np.array(owner, np.int64), np.array(place, np.int64)

    def candidates(self, docs: list[list[str]]) -> dict[tuple[int, int], set[int]]:
        """(place of the document, place of the item) -> diagonals (document position less item position) of windows that meet."""
        get = self.code.get
        codes = np.array([get(w, -1) for d in docs for w in d], dtype=np.int64)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        end = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(docs)), sizes)
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for window, (index, item, place) in self.by_window.items():
            # An untouched window has none but the items' words, and ends in its document.
            at = np.arange(max(0, len(codes) - window + 1))
            at = at[(known[at + window] - known[at] == window) & (at + window <= end[owner[at]])]
            if not len(at):
                continue
            q, p = index.near(simhashes(codes, at, self.bits, window))
            q = at[q]
            start = q - (end[owner[q]] - sizes[owner[q]])
            for d, i, diagonal in zip(owner[q].tolist(), item[p].tolist(), (start - place[p]).tolist(), strict=True):
                out[d, i].add(diagonal)
        return out

    def held(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """(place of the document, item_id, words held) of every item that one of the documents holds; documents are looked up together."""
        if not self.items or not docs:
            return
        for (d, i), diagonals in self.candidates(docs).items():
            doc, (item_id, passage), best = docs[d], self.items[i], 0
            n = len(passage.words)
            reach = EDITS * (2 + n // STRETCH)
            runs: list[list[int]] = []
            for x in sorted(diagonals):
                if runs and x - runs[-1][1] <= reach:
                    runs[-1][1] = x
                else:
                    runs.append([x, x])
            for low, high in runs:
                piece = doc[max(0, low - reach) : min(len(doc), high + n + reach)]
                if best < n and passage.similar(piece):
                    best = max(best, words_held(align(passage.words, piece), passage.words))
            if best:
                yield d, item_id, best


def together(texts: list[list[str]], most: int = WORDS_TOGETHER) -> Iterator[tuple[int, list[list[str]]]]:
    """(place of the first, texts) of runs of texts with about `most` words; a longer text is a run of its own."""
    begin = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield begin, texts[begin:i]
            begin, n = i, 0
        n += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


#: The index of one block of items per worker process; tasks of one worker share it.
_INDEX: dict[str, PassageIndex] = {}


def worker_index(key: str, items: list[tuple[int, str]]) -> PassageIndex:
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = PassageIndex(items)
    return _INDEX[key]


def found_passages(documents: DataFrame, items: DataFrame, most_fingerprints: int = MOST_FINGERPRINTS) -> DataFrame:
    """doc_id, item_id, words_held of every document that holds an item's passage or STRETCH words of it."""
    spark = documents.sparkSession
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), ["doc_id"])
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("item_id is not null and passage is not null").distinct()
    # A word takes two letters with its blank, so this bounds the windows of a block (but for one passage longer than a block).
    n_letters = asked.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_blocks = max(1, math.ceil(n_letters / 2 / most_fingerprints))
    if n_blocks > 1:
        # Several blocks read the documents several times: fold them once.
        def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "text": [" ".join(words(t)) for t in b["text"]]})

        texts = cut_lineage(texts.mapInPandas(folded, "doc_id long, text string"))
    out = None
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        shared, key = spark.sparkContext.broadcast([(r.item_id, r.passage) for r in part]), uuid.uuid4().hex

        def look(batches: Iterator[pd.DataFrame], shared=shared, key=key, is_folded=n_blocks > 1) -> Iterator[pd.DataFrame]:
            index = worker_index(key, shared.value)
            for b in batches:
                ids = b["doc_id"].tolist()
                docs = [t.split() if is_folded else words(t) for t in b["text"]]
                rows = [(ids[begin + d], item_id, n) for begin, run in together(docs) for d, item_id, n in index.held(run)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words_held"])

        got = texts.mapInPandas(look, "doc_id long, item_id long, words_held int")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(F.max("words_held").alias("words_held"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: benchmark, documents that hold it, whole copies, and most words held."""
    size = items.select("item_id", "benchmark").distinct()
    return found_passages(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words_held").alias("most_words")).join(size, "item_id")
