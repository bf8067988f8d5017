"""Abusive, hateful and sexual content: class-conditional Kneser-Ney models of letters, one toxic and one ordinary.

A passage's score is the difference of its log-likelihoods under both models, divided by its length (plus SHRINK, so that a few
letters prove little); a sentence scores as its worst window of WINDOW letters, a document as its worst sentence. Orders above SHARED have counts of their own class, the
lower ones pool both, so a rare expression is smoothed alike in both models and only what the classes really differ in counts.

The reviews label documents, not sentences, and slip at times. Training therefore alternates: models fitted on other folds score the
sentences of each labelled document, and only sentences that look toxic there move to the toxic model (of a toxic document at least
its worst one while it is above the ordinary level). The threshold is the one that separates held-out reviewed documents best.
Models are fitted on at most MAX_LABELLED reviewed documents of at most MAX_LETTERS letters (whole texts, chosen by a hash of the id);
every document is scored in full.

Defined results: null and empty texts score nothing below any threshold (score null, not offensive); opinions that are null count for
nothing, and a tie of opinions drops the document from training; without labels of both kinds no document is a case; repeated rows
give one row each; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.text import fold
from framewright.operators.skew import spread
from framewright.session import cut_lineage

ORDER = 6
SHARED = 2
SHRINK = 15
WINDOW = 48
FOLDS = 3
ROUNDS = 2
MAX_LABELLED = 8_000
MAX_LETTERS = 50_000_000
PIECE = 160
CACHE = 300_000
DISCOUNT = 0.75
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_·]){2,}[^\W\d_](?![^\W_])")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")
SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|[\r\n]+|\s\|\s")
MASKED = re.compile(r"[0134578@$](?<=[^\W\d_][0134578@$])(?=[^\W\d_])")
NUMBERS = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
GAPS, OTHER, DIGITS = re.compile(r"[ .*_·]"), re.compile(r"[^\w*]+"), re.compile(r"\d+")
# Signs that stand for letters inside a word.
LEET = str.maketrans("0134578@$", "oieastbas")


def plain(sentence: str) -> str:
    """Letters, single blanks and masks; spelled-out, stretched and disguised words as written plainly; numbers as 0."""
    s = MASKED.sub(lambda m: m[0].translate(LEET), sentence)
    s = SPACED.sub(lambda m: GAPS.sub("", m[0]), s)
    return DIGITS.sub("0", OTHER.sub(" ", REPEAT.sub(r"\1", s))).strip()


def raw_sentences(text: str) -> list[str]:
    """Sentences of the folded text. Numbers that touch no letter are 0 already here, as they will be in plain(), so more sentences are alike."""
    return SPLIT.split(NUMBERS.sub("0", fold(text)))


def pieces(raw: str) -> list[str]:
    """A sentence as written plainly; one over PIECE letters is cut into overlapping pieces at blanks."""
    s, out = plain(raw), []
    if len(s) <= PIECE:
        return [s] if s else []
    start = 0
    while start < len(s):
        end = start + PIECE
        if end < len(s) and (cut := s.rfind(" ", start + PIECE // 2, end)) > 0:
            end = cut
        out.append(s[start:end].strip())
        if end >= len(s):
            break
        start = s.rfind(" ", start, (start + end) // 2) + 1 or (start + end) // 2
        start = max(start, end - PIECE + 1)
    return out


def sentences(text: str) -> list[str]:
    """Plain sentences of a text, long ones in pieces."""
    return [p for raw in raw_sentences(text) for p in pieces(raw)]


class Letters:
    """Hashes of the grams that end at each letter (and end mark) of some texts, with the filling letters before each text's first."""

    def __init__(self, texts: list[str]) -> None:
        pad = "\x02" * (ORDER - 1)
        codes = np.frombuffer("".join(f"{pad}{t}\x03" for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(t) + ORDER for t in texts], dtype=np.int64)
        self.real = np.flatnonzero(codes != 2)
        self.owner = np.repeat(np.arange(len(texts)), sizes)[self.real]
        past = codes + np.uint64(1)
        h = np.zeros(len(codes), np.uint64)
        #: By order, over all places; a gram's history is the gram of one order less at the place before.
        self.hash = [h]
        for k in range(1, ORDER + 1):
            # Built to the left, so that the hash of order k - 1 is that of the gram without its first letter.
            shifted = np.zeros_like(past)
            shifted[k - 1 :] = past[: len(past) - k + 1]
            h = (h * BASE) ^ (shifted * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k))
            self.hash.append(h)


class GramSet:
    """The distinct grams of some texts by order, each with its suffix (one letter less) and its history, and where they stand."""

    def __init__(self, texts: list[str]) -> None:
        x = Letters(texts)
        self.owner, self.ids, self.kinds = x.owner, [], []
        for k in range(1, ORDER + 1):
            u, first, at = np.unique(x.hash[k][x.real], return_index=True, return_inverse=True)
            place = x.real[first]
            self.ids.append(at)
            self.kinds.append((u, x.hash[k - 1][place], x.hash[k - 1][place - 1], x.hash[max(0, k - 2)][place - 1]))

    def of(self, chosen: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """By order: the grams of the chosen texts (all by default), their suffixes, histories, histories of the suffixes, and counts."""
        here = None if chosen is None else chosen[self.owner]
        out = []
        for ids, kinds in zip(self.ids, self.kinds, strict=True):
            n = np.bincount(ids if here is None else ids[here], minlength=len(kinds[0]))
            on = n > 0
            out.append((*(x[on] for x in kinds), n[on]))
        return out


Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def kneser_ney(sets: list[list[tuple[np.ndarray, ...]]], orders: range) -> dict[int, Table]:
    """Per order: grams with their discounted share, and histories with their backoff weight, of the texts of all sets together."""
    out = {}
    for k in orders:
        if k == ORDER:
            (u, _, hist, _, n), *rest = [s[k - 1] for s in sets]
            if rest:
                raise ValueError("the highest order is not shared")
        else:
            # Continuations: distinct (k+1)-grams that end in the k-gram.
            gram, suffix, _, back = (np.concatenate([s[k][i] for s in sets]) for i in range(4))
            if len(sets) > 1:
                _, one = np.unique(gram, return_index=True)
                suffix, back = suffix[one], back[one]
            u, at, n = np.unique(suffix, return_index=True, return_counts=True)
            hist = back[at]
        h, group = np.unique(hist, return_inverse=True)
        total = np.bincount(group, weights=n)
        out[k] = (u, (n - DISCOUNT) / total[group], h, DISCOUNT * np.bincount(group) / total)
    return out


class Lookup:
    """Places of 64-bit keys by their leading hash bits; keys that meet another in their slot are searched."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n, self.bits = len(keys), np.uint64(max(4, int(4 * len(keys) + 1).bit_length()))
        self.keys = np.concatenate([keys, [np.uint64(0)]])
        self.slot = np.full(1 << int(self.bits), self.n, np.int32)
        s = self.slots(keys)
        self.slot[s[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        late = np.flatnonzero(self.slot[s] != np.arange(len(keys)))
        order = np.argsort(keys[late], kind="stable")
        self.late_keys, self.late = keys[late][order], late[order].astype(np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - self.bits)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Place of each key, or the number of keys where it is not one."""
        at = self.slot[self.slots(asked)]
        miss = np.flatnonzero((self.keys[at] != asked) & (at < self.n))
        if len(miss):
            at[miss] = self.n
            if len(self.late):
                want = asked[miss]
                i = np.minimum(np.searchsorted(self.late_keys, want), len(self.late) - 1)
                ok = self.late_keys[i] == want
                at[miss[ok]] = self.late[i[ok]]
        return at


class Model:
    """Both class models with their shared low orders: one table per order, with the shares of its grams and their weights as histories."""

    def __init__(self, toxic: list[tuple[np.ndarray, ...]], ordinary: list[tuple[np.ndarray, ...]]) -> None:
        shared = kneser_ney([toxic, ordinary], range(1, SHARED + 1))
        both = [shared | kneser_ney([x], range(SHARED + 1, ORDER + 1)) for x in (toxic, ordinary)]
        self.first = [t[1][3][0] for t in both]  # weight of the empty history
        self.tables = []
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in both] + [t[k + 1][2] for t in both if k < ORDER]))
            share, back = np.zeros((2, len(keys) + 1), np.float32), np.ones((2, len(keys) + 1), np.float32)
            for c, t in enumerate(both):
                share[c, np.searchsorted(keys, t[k][0])] = t[k][1]
                if k < ORDER:
                    back[c, np.searchsorted(keys, t[k + 1][2])] = t[k + 1][3]
            self.tables.append((Lookup(keys), share, back))

    def probabilities(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Probability of each letter (and end mark) of all texts under both models, and the text it is of."""
        x = Letters(texts)
        p, last = [np.full(len(x.real), 1e-4), np.full(len(x.real), 1e-4)], None
        for k, (lookup, share, back) in enumerate(self.tables, 1):
            at = lookup.places(x.hash[k])
            here = at[x.real]
            for c in range(2):
                weight = self.first[c] if last is None else last[1][c][last[0]]
                p[c] = share[c][here] + weight * p[c]
            last = at[x.real - 1], back
        return p, x.owner

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio of each letter (and end mark) of all texts, and the text it is of."""
        p, owner = self.probabilities(texts)
        return np.log(p[0] / p[1]), owner

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ratio, owner = self.letters(texts)
        first = np.searchsorted(owner, np.arange(len(texts)))
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        at = np.arange(len(owner))
        start = np.maximum(first[owner], at - WINDOW + 1)
        value = (total[at + 1] - total[start]) / (at + 1 - start + SHRINK)
        # Only whole windows count, or the whole of a shorter text: a text's first letters alone say little.
        size = np.bincount(owner, minlength=len(texts))
        value[at + 1 - first[owner] < np.minimum(size, WINDOW)[owner]] = -np.inf
        return np.maximum.reduceat(value, first)

    def core(self, texts: list[str], least: float) -> list[str]:
        """Of each text the stretch of whole words in which the ratio exceeds `least` by most; a text may run two sentences together."""
        ratio, owner = self.letters(texts)
        first = [*np.searchsorted(owner, np.arange(len(texts))), len(owner)]
        out = []
        for i, t in enumerate(texts):
            run, best, begin, span = 0.0, -np.inf, 0, (0, len(t))
            for j, v in enumerate(ratio[first[i] : first[i + 1]].tolist()):
                if run <= 0:
                    run, begin = 0.0, j
                run += v - least
                if run > best:
                    best, span = run, (begin, j + 1)
            low, high = t.rfind(" ", 0, span[0] + 1) + 1, t.find(" ", min(span[1], len(t)))
            out.append(t[low : high if high >= 0 else len(t)].strip() or t)
        return out


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap with the best F1 on held-out documents."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    top = f1.max(initial=0)
    good = np.flatnonzero(f1 >= top - 1e-9)
    k = int(good[len(good) // 2])
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def trained(labelled: list[tuple[int, int, str]]) -> tuple[Model, float] | None:
    """Model and threshold from (doc_id, label, text); None unless both labels occur."""
    read: dict[str, list[str]] = {}
    docs = []
    for d, y, t in labelled:
        raws = raw_sentences(t)
        read.update((raw, pieces(raw)) for raw in raws if raw not in read)
        docs.append((d, y, list(dict.fromkeys(p for raw in raws for p in read[raw]))))
    docs = [x for x in docs if x[2]]
    if {y for _, y, _ in docs} != {0, 1}:
        return None
    # Every sentence's grams are found once; a fold's counts are then sums over its sentences.
    every = sorted({s for _, _, sents in docs for s in sents})
    place, grams = {s: i for i, s in enumerate(every)}, GramSet(every)
    fold_of = [zlib.crc32(str(d).encode()) % FOLDS for d, _, _ in docs]
    # Reviews slip both ways, so a sentence counts as clean only where at least as many clean documents as toxic ones have it.
    votes = {y: Counter(s for _, label, sents in docs if label == y for s in sents) for y in (0, 1)}
    clean = {s for s, n in votes[0].items() if n >= votes[1][s]}
    # First guess: what toxic documents say and clean ones do not. Later: what models of the other folds find toxic.
    bad: dict[str, str] = {s: s for s in votes[1] if s not in clean}
    slips = outvoted = {s for s in votes[0] if s not in clean}
    threshold = 0.0

    def fitted(some: list[tuple[int, int, list[str]]]) -> Model | None:
        toxic, ordinary = training_sets(some, bad, slips)
        if not toxic or not ordinary:
            return None
        chosen = np.zeros(len(every), bool)
        chosen[[place[s] for s in ordinary]] = True
        return Model(GramSet(toxic).of(), grams.of(chosen))

    for _ in range(ROUNDS + 1):
        got: dict[str, list[float]] = {}
        cut: dict[str, str] = {}
        held: list[tuple[float, int]] = []
        for f in range(FOLDS):
            model = fitted([x for x, g in zip(docs, fold_of, strict=True) if g != f])
            if model is None:
                continue
            test = [x for x, g in zip(docs, fold_of, strict=True) if g == f]
            asked = sorted({s for _, _, sents in test for s in sents})
            value = dict(zip(asked, model.scores(asked).tolist(), strict=True))
            for s, v in value.items():
                got.setdefault(s, []).append(v)
            suspect = sorted({s for _, y, sents in test if y for s in sents if value[s] > 0})
            cut.update(zip(suspect, model.core(suspect, 0.2), strict=True) if suspect else ())
            held += [(max(value[s] for s in sents), y) for _, y, sents in test]
        if not held:
            break
        guess = {s: sum(v) / len(v) for s, v in got.items()}
        threshold = best_threshold(np.array([v for v, _ in held]), np.array([y for _, y in held]))
        bad = {s: c for s, c in cut.items() if guess[s] > threshold}
        # A clean document's sentence counts as a slip of the review only if it is as toxic as the plainly toxic ones.
        plainly = float(np.median([guess[s] for s in bad])) if bad else np.inf
        slips = outvoted | {s for s in clean if guess.get(s, 0.0) > plainly}
    model = fitted(docs)
    return (model, threshold) if model else None


def training_sets(docs: list[tuple[int, int, list[str]]], bad: dict[str, str], slips: set[str]) -> tuple[list[str], list[str]]:
    """(toxic passages, ordinary sentences) of labelled documents: of a toxic document the bad sentences' cores are toxic."""
    toxic = {bad[s] for _, y, sents in docs if y for s in sents if s in bad}
    ordinary = {s for _, y, sents in docs for s in sents if not (y and s in bad) and s not in slips}
    return sorted(toxic), sorted(ordinary - toxic)


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, letters: int = MAX_LETTERS) -> list[tuple[int, int, str]]:
    """(doc_id, label, text) of at most bound reviewed documents of at most so many letters in all, by majority of the opinions."""
    votes = labels.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg(F.col("offensive").cast("double")).alias("share")).where("share <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    # At most `bound` rows of two numbers are broadcast.
    # At most `bound` rows of two numbers are broadcast, and as many met; their lengths are summed to bound the letters too.
    met = cut_lineage(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("_h", F.xxhash64("doc_id")))
    sizes = [(r.doc_id, r.n) for r in met.groupBy("doc_id", "_h").agg(F.sum(F.length("text")).alias("n")).orderBy("_h", "doc_id").select("doc_id", "n").collect()]
    total, kept = 0, []
    for doc_id, n in sizes:
        total += n
        if total <= letters:
            kept.append(doc_id)
    rows = met.where(F.col("doc_id").isin(kept)).toLocalIterator() if len(kept) < len(sizes) else met.toLocalIterator()
    return sorted((r.doc_id, r.label, r.text) for r in rows)


#: What sentences read as, and the scores of their pieces, per worker process and model; tasks of one worker share them.
_CACHES: dict[str, tuple[dict[str, list[str]], dict[str, float]]] = {}


def worker_cache(key: str) -> tuple[dict[str, list[str]], dict[str, float]]:
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = {}, {}
    return _CACHES[key]


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score, offensive of every document."""
    model = trained(labelled_sample(documents, labels))
    base = documents.select("doc_id", "source", "text").where("doc_id is not null")
    if model is None:
        return base.select("doc_id", "source", F.lit(None).cast("double").alias("score"), F.lit(False).alias("offensive"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    key = uuid.uuid4().hex

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, threshold = shared.value
        read, known = worker_cache(key)
        for b in batches:
            for start in range(0, len(b), 200):
                part = b.iloc[start : start + 200]
                split = [raw_sentences(t) if isinstance(t, str) else [] for t in part["text"]]
                for cache in (read, known):
                    if len(cache) > CACHE:
                        cache.clear()
                # A sentence is read once, and what it reads as is scored once, however often either stands in a worker's documents.
                for raw in dict.fromkeys(x for xs in split for x in xs):
                    if raw not in read:
                        read[raw] = pieces(raw)
                fresh = list(dict.fromkeys(p for xs in split for x in xs for p in read[x] if p not in known))
                for at in range(0, len(fresh), 2000):
                    some = fresh[at : at + 2000]
                    known.update(zip(some, m.scores(some).tolist(), strict=True))
                worst = [max((known[p] for x in xs for p in read[x]), default=None) for xs in split]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "score": pd.Series(worst, dtype="Float64"), "offensive": [w is not None and w >= threshold for w in worst]})

    return spread(base, ["doc_id"]).mapInPandas(score, "doc_id long, source string, score double, offensive boolean")


def source_rates(scores: DataFrame) -> DataFrame:
    """Per source: documents, offensive ones and their rate."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("offensive").alias("n_offensive"), F.avg(F.col("offensive").cast("double")).alias("rate"))
