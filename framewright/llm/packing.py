"""Filling fixed-capacity containers with documents: pattern packing by non-negative least squares.

Packing is decided on the histogram of lengths, never on documents: patterns of up to three length buckets that fill a container
exactly are enumerated, repeat counts are fitted to the bucket histogram by non-negative least squares, rounded down to what the
histogram holds, and the residual histogram is packed best-fit by decreasing length. The histogram has at most one entry per token
up to the capacity (their sum is checked against MAX_CAPACITY), however many documents there are. Documents are ranked within their length, and
each rank interval of a length is told its containers in closed form, so placing them is one join to a small table.

A document longer than the capacity is cut into full pieces, each a container of its own, and a rest that is packed like any other.
Where documents are much shorter than the container, no few-document pattern fills it: patterns then fill bundles, several of which
make a container (class Packing), and longer documents reach the residual step, which also fills what bundles leave.

Defined results: null and empty texts have no tokens and are not packed; specifications with null or non-positive capacity are left
out; repeated specification rows count once; rows of one doc_id with different texts count as separate documents only if doc_id
differs (the largest text of an id is packed); empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

import base64
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import numbered
from framewright.operators.skew import spread
from framewright.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern of the byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CAPACITY = 1 << 20
MAX_SPECS = 1000
BUCKETS = 256
KEPT_BACK = 0.1
PLACE = "spec_id int, length long, from_pos long, to_pos long, shift long, per long, bundle long, bundles long"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens over the whole text of each document that has any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''"), ["doc_id"])
    return texts.mapInPandas(count, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson, which ends after finitely many steps; rounding could make it
    cycle, so after ten steps a column it stops with a warning (what is not fitted is packed as residual)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(10 * n):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(w.argmax())
        if w[j] <= tolerance:
            return x
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            part = a[:, at]
            gram = part.T @ part
            gram.flat[:: len(at) + 1] += 1e-12 * max(1.0, float(gram.max(initial=0)))
            s = np.linalg.solve(gram, part.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / (x[at][bad] - s[bad] + 1e-300))
            x[at] += step * (s - x[at])
            free[at[(x[at] <= 1e-12)]] = False
            x[~free] = 0
            if not free.any():
                break
    warnings.warn("least squares stopped before it settled; more documents are packed as residual", stacklevel=2)
    return x


def patterns(capacity: int) -> list[tuple[int, ...]]:
    """All ways to fill capacity with one, two or three buckets, in descending order within each."""
    out: list[tuple[int, ...]] = [(capacity,)]
    out += [(i, capacity - i) for i in range(capacity - 1, (capacity - 1) // 2, -1) if i >= capacity - i > 0]
    for i in range(capacity - 2, 0, -1):
        for j in range(min(i, capacity - i - 1), 0, -1):
            k = capacity - i - j
            if k > j:
                break
            if k > 0:
                out.append((i, j, k))
    return out


class Packing:
    """Rank intervals per length, and how many containers are used.

    Patterns of a few documents fill a container only where documents are not much shorter than it. Where they are, patterns fill
    bundles, and `bundles` of them make a container. KEPT_BACK of the documents short enough for bundles are left to the residual
    step, where they fill what longer documents leave.
    """

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.n_containers = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []
        self.spare: list[tuple[int, int, int]] = []  # space left by bundles: space, first container, containers
        self.left = dict(sorted(histogram.items()))
        self.used = dict.fromkeys(self.left, 0)
        self.by_pattern = 0
        if self.left:
            self.fit_patterns()
            self.pack_residual()

    def bundles(self) -> int:
        """Into how many bundles a container is cut: none where three documents about fill half of it, else bundles that three of them fill, of
        at most BUCKETS tokens, so that lengths need no rounding."""
        mean = sum(k * c for k, c in self.left.items()) / sum(self.left.values())
        return max(1, self.capacity // max(1, min(BUCKETS, int(3 * mean)))) if self.capacity >= 6 * mean else 1

    def fit_patterns(self) -> None:
        per = self.bundles()
        room = self.capacity // per
        grain = -(-room // BUCKETS)
        top = room // grain
        buckets: dict[int, list[int]] = {}
        for length in self.left:
            buckets.setdefault(-(-length // grain), []).append(length)
        share = 1.0 if per == 1 else 1 - KEPT_BACK
        have = {b: int(share * sum(self.left[n] for n in lengths)) for b, lengths in buckets.items() if b <= top}
        usable = [p for p in patterns(top) if all(b in have for b in p)]
        if not usable:
            return
        row = {b: i for i, b in enumerate(have)}
        a = np.zeros((len(have), len(usable)))
        for j, p in enumerate(usable):
            for b in p:
                a[row[b], j] += 1
        target = np.array([have[b] for b in row], dtype=float)
        # Long documents are hard to place later, so their misfit weighs more.
        weight = np.sqrt(np.array(list(row), dtype=float))
        x = nnls(a * weight[:, None], target * weight)
        made = 0
        for j in np.argsort(-x, kind="stable"):
            need = {b: usable[j].count(b) for b in usable[j]}
            n = min(int(x[j] + 1e-6), *(have[b] // m for b, m in need.items()))
            if n > 0:
                for b, m in need.items():
                    have[b] -= n * m
                    self.take(buckets[b], n * m, m, made, per)
                made += n
        whole, rest = divmod(made, per)
        self.n_containers = self.by_pattern = whole + (rest > 0)
        self.spare = [(self.capacity - per * room, 0, whole), (self.capacity - rest * room, whole, int(rest > 0))]

    def take(self, lengths: list[int], count: int, per: int, bundle: int, bundles: int = 1) -> None:
        """Give the next count documents of these lengths, longest first, to bundles from `bundle` on, `per` to each; `bundles` make a container."""
        done = 0
        for n in reversed(lengths):
            k = min(self.left[n], count - done)
            if k:
                self.rows.append((n, self.used[n], self.used[n] + k, done - self.used[n], per, bundle, bundles))
                self.left[n] -= k
                self.used[n] += k
                done += k
            if done == count:
                return

    def pack_residual(self) -> None:
        spaces: dict[int, list[tuple[int, int]]] = {}  # space -> (first container, containers)
        order: list[int] = []  # spaces that occur, ascending
        from bisect import bisect_left, insort

        def put(space: int, first: int, n: int) -> None:
            if n and space > 0:
                if space not in spaces:
                    insort(order, space)
                spaces.setdefault(space, []).append((first, n))

        for space, first, n in self.spare:
            put(space, first, n)
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            while self.left[length]:
                at = bisect_left(order, length)
                if at == len(order):
                    per = self.capacity // length
                    first, n, space = self.n_containers, -(-self.left[length] // per), self.capacity
                    self.n_containers += n
                else:
                    space = order[at]
                    first, n = spaces[space].pop()
                    if not spaces[space]:
                        del spaces[space], order[at]
                    per = space // length
                count = self.left[length]
                full = min(n, count // per)
                if full:
                    self.take([length], full * per, per, first)
                    put(space - per * length, first, full)
                rest = self.left[length] if full < n else 0
                if 0 < rest < per:
                    self.take([length], rest, rest, first + full)
                    put(space - rest * length, first + full, 1)
                    full += 1
                put(space, first + full, n - full)


def pieces(lengths: DataFrame, listed: dict[int, int]) -> DataFrame:
    """spec_id, doc_id, full (pieces of whole capacity), rest (tokens left over) and capacity, per document and specification."""
    if not listed:
        return lengths.limit(0).select(F.lit(0).alias("spec_id"), "doc_id", F.lit(0).cast("long").alias("full"), F.col("n_tokens").alias("rest"), F.lit(1).cast("long").alias("capacity"))
    spec = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for i, c in listed.items()]))
    every = lengths.select("doc_id", "n_tokens", spec.alias("s"))
    return every.select("s.spec_id", "doc_id", F.expr("n_tokens div s.capacity").alias("full"), (F.col("n_tokens") % F.col("s.capacity")).alias("rest"), "s.capacity")


def packed(documents: DataFrame, pack_specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """spec_id, doc_id, piece_no, token_from, n_tokens, container_id: every piece of every document, once per specification."""
    spark = documents.sparkSession
    specs = pack_specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    listed = {r.spec_id: r.capacity_tokens for r in specs.limit(MAX_SPECS + 1).collect()}
    if len(listed) > MAX_SPECS or sum(listed.values()) > MAX_CAPACITY:
        raise ValueError("too many specifications, or capacities beyond MAX_CAPACITY in total")
    lengths = cut_lineage(token_lengths(documents, tokenizer))
    every = pieces(lengths, listed)
    rest = numbered(every.where("rest > 0").select("spec_id", F.col("rest").alias("length"), "doc_id", "full"), ["spec_id", "length"], ["doc_id"])
    rest = cut_lineage(rest)
    counts = rest.groupBy("spec_id", "length").agg(F.count(F.lit(1)).alias("n")).collect()
    rows: list[tuple] = []
    offset = {}
    histograms: dict[int, dict[int, int]] = {i: {} for i in listed}
    for r in counts:
        histograms[r.spec_id][r.length] = r.n
    for spec_id, capacity in listed.items():
        p = Packing(histograms[spec_id], capacity)
        rows += [(spec_id, *r) for r in p.rows]
        offset[spec_id] = p.n_containers
    table = spark.createDataFrame(rows, PLACE)
    # At most a few intervals per length and pattern, whatever the corpus: bounded by the capacities.
    inside = (F.col("pos") >= F.col("from_pos")) & (F.col("pos") < F.col("to_pos"))
    placed = rest.join(F.broadcast(table), ["spec_id", "length"]).where(inside)
    placed = placed.select("spec_id", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * capacity_of(listed)).alias("token_from"), F.col("length").alias("n_tokens"), F.expr("(bundle + (pos + shift) div per) div bundles").alias("container_id"))
    whole = every.where("full > 0").select("spec_id", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"), "capacity")
    whole = numbered(whole, ["spec_id"], ["doc_id", "piece_no"])
    first = F.create_map(*[F.lit(x) for kv in offset.items() for x in (kv[0], int(kv[1]))]) if offset else F.create_map(F.lit(0), F.lit(0))
    whole = whole.select("spec_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("n_tokens"), (first[F.col("spec_id")] + F.col("pos")).alias("container_id"))
    return placed.unionByName(whole)


def capacity_of(listed: dict[int, int]):
    if not listed:
        return F.lit(0).cast("long")
    return F.create_map(*[F.lit(x) for kv in listed.items() for x in (kv[0], int(kv[1]))])[F.col("spec_id")].cast("long")


def fill_report(assigned: DataFrame, pack_specs: DataFrame) -> DataFrame:
    """Per specification: containers, pieces, tokens, and the share of the containers' room that is filled."""
    per = assigned.groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    specs = pack_specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return per.join(specs, "spec_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
