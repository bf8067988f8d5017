"""Similarity flooding between two small schemas (after Melnik, Garcia-Molina, Rahm: ICDE 2002).

A schema is a graph: a root, its fields, the type of each field, and below objects and lists their own fields, at any depth. Match
scores start from the names and flow along equally labelled edges of both graphs (field to child, child to field, field to
type and back) until they stop changing; every pair's flow is shared among the pairs it goes to, so the sum is a contraction and always
settles. The settled score accepts or rejects a pair, and a one-to-one selection keeps the pairs that both sides prefer.

Names start with the weighted cosine of their words. A word's weight comes from the files themselves: a word that several fields of
one file bear (a prefix, a unit, a count) says where or how, not which, and weighs 1/n² for n such fields. Words also meet as
initials (lr, learning rate), as beginnings and as near spellings. Names with different numbers (mAP50, mAP50-95) never match.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from typing import Any, NamedTuple

ACCEPT = 0.55
CHILDREN, PARENT, TYPE = 0.7, 0.1, 0.05
NEAR = 0.8
SETTLED = 1e-7


class Field(NamedTuple):
    """A field of a schema: name, type (None: not known), shape (JSON skeleton of an object or list), and the fields per file of its shared words."""

    name: str
    type: str | None = None
    shape: str | None = None
    shared: tuple[tuple[str, int], ...] = ()


@lru_cache(maxsize=50_000)
def tokens(name: str) -> tuple[str, ...]:
    """Words in small letters and numbers of a name, in order; zeros only count positions and are left out."""
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z]{2})(?=[A-Z])", " ", name)
    found = [p.lower() if not p.isdigit() else p.lstrip("0") for p in re.findall(r"[^\W\d_]+|\d+", spaced)]
    return tuple(p for p in found if p)


def spelled(name: str) -> str:
    """One spelling of all that differ only in case, separators and zeros."""
    return "_".join(tokens(name)) or name


def words_of(name: str) -> dict[str, None]:
    return dict.fromkeys(t for t in tokens(name) if not t.isdigit())


def numbers_of(name: str) -> frozenset[str]:
    return frozenset(t for t in tokens(name) if t.isdigit())


@lru_cache(maxsize=50_000)
def word_likeness(a: str, b: str) -> float:
    """1 for equal words, NEAR where one begins the other or their letter triples mostly agree, else 0."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return NEAR
    grams = [{f"  {w} "[i : i + 3] for i in range(len(w) + 1)} for w in (a, b)]
    return NEAR if 2 * len(grams[0] & grams[1]) >= 1.3 * (len(grams[0]) + len(grams[1])) / 2 else 0.0


def initials(short: list[str], long: list[str]) -> tuple[str, list[str]] | None:
    """A word of two to four letters and the neighbouring words it abbreviates."""
    for w in short:
        for i in range(len(long) - len(w) + 1) if 2 <= len(w) <= 4 else ():
            if "".join(x[0] for x in long[i : i + len(w)]) == w:
                return w, long[i : i + len(w)]
    return None


def name_similarity(a: Field, b: Field) -> float:
    """0 to 1: weighted cosine of the words of two names; 0 if their numbers differ."""
    if numbers_of(a.name) != numbers_of(b.name):
        return 0.0
    wa, wb = list(words_of(a.name)), list(words_of(b.name))
    if not wa or not wb:
        return float(spelled(a.name) == spelled(b.name))
    fans = {w: n for f in (a, b) for w, n in sorted(f.shared, key=lambda x: x[1])}
    weight = {w: 1.0 / fans.get(w, 1) ** 2 for w in (*wa, *wb)}
    size = math.sqrt(sum(weight[w] for w in wa) * sum(weight[w] for w in wb))
    both = 0.0
    pairs = sorted(((word_likeness(x, y), x, y) for x in wa for y in wb), key=lambda p: (-p[0], p[1], p[2]))
    for like, x, y in pairs:
        if like and x in wa and y in wb:
            both += like * math.sqrt(weight[x] * weight[y])
            wa.remove(x)
            wb.remove(y)
    for short, long in ((wa, wb), (wb, wa)):
        if found := initials(short, long):
            both += math.sqrt(weight[found[0]] * sum(weight[w] for w in found[1]))
            short.remove(found[0])
            for w in found[1]:
                long.remove(w)
    return min(1.0, both / size)


def skeleton(value: Any) -> Any:
    """The structure of a value: objects by field, lists by their distinct element structures, other values by type."""
    if isinstance(value, dict):
        return {k: skeleton(v) for k, v in value.items()}
    if isinstance(value, list):
        kinds = {json.dumps(s, sort_keys=True): s for s in map(skeleton, value)}
        return [kinds[k] for k in sorted(kinds)]
    return {bool: "boolean", int: "number", float: "number", str: "text"}.get(type(value), "")


def children(shape: Any) -> list[tuple[str, str, Any]]:
    """(name, type, shape) below a shape; the fields of objects in a list are the list's own, other elements have the empty name."""
    if isinstance(shape, dict):
        return [(k, kind(s), s) for k, s in shape.items()]
    if isinstance(shape, list):
        return [c for s in shape for c in (children(s) if isinstance(s, dict) else [("", kind(s), s)])]
    return []


def kind(shape: Any) -> str:
    return "object" if isinstance(shape, dict) else "list" if isinstance(shape, list) else shape


def settled(left: tuple[Field, ...], right: tuple[Field, ...]) -> dict[tuple[int, int], float]:
    """Settled score of each pair (place in left, place in right)."""
    start: list[float] = []
    types: list[str | None] = []
    flows: list[tuple[int, int, float]] = []  # from, to, share
    base: list[float] = []
    by_type: dict[str, list[int]] = {}

    def pair(a: Field, b: Field, above: int | None) -> int:
        me = len(start)
        start.append(name_similarity(a, b) if a.name or b.name else 1.0)
        types.append(a.type if a.type and a.type == b.type else None)
        base.append(1.0)
        if types[me]:
            by_type.setdefault(f"{types[me]}", []).append(me)
        if above is not None:
            flows.append((above, me, PARENT))
            base[me] -= PARENT
        return me

    top: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, Any, Any]] = []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            top[i, j] = me = pair(a, b, None)
            if a.shape and b.shape and a.type == b.type:
                todo.append((me, json.loads(a.shape), json.loads(b.shape)))
    while todo:
        me, sa, sb = todo.pop()
        ca, cb = children(sa), children(sb)
        if not ca or not cb:
            continue
        base[me] -= CHILDREN
        # Children meet under equal names first; what is left over meets by likeness.
        names = {n: (n, t, s) for n, t, s in cb}
        met = [(c, names[c[0]]) for c in ca if c[0] in names]
        rest_a, rest_b = [c for c in ca if c[0] not in names], [c for c in cb if c[0] not in {x[0] for x in ca}]
        met += [(x, y) for x in rest_a for y in rest_b if name_similarity(Field(x[0]), Field(y[0])) >= ACCEPT]
        for x, y in met:
            child = pair(Field(x[0], x[1]), Field(y[0], y[1]), me)
            # Shared among all that come, so that what a pair gets never exceeds CHILDREN.
            flows.append((child, me, CHILDREN / max(len(ca), len(cb), len(met))))
            if x[1] == y[1] and isinstance(x[2], dict | list):
                todo.append((child, x[2], y[2]))
    for members in by_type.values():
        # The type's own pair: it gathers from its fields and hands the mean back.
        me = len(start)
        start.append(0.0)
        base.append(0.0)
        for m in members:
            flows.append((m, me, 1.0 / len(members)))
            flows.append((me, m, TYPE))
            base[m] -= TYPE
    score = list(start)
    while True:
        new = [max(0.0, w) * s for w, s in zip(base, start, strict=True)]
        for a, b, share in flows:
            new[b] += share * score[a]
        new = [min(1.0, v) for v in new]
        moved = max((abs(x - y) for x, y in zip(new, score, strict=True)), default=0.0)
        score = new
        if moved < SETTLED:
            return {ij: score[me] for ij, me in top.items()}


@lru_cache(maxsize=50_000)
def match_fields(left: tuple[Field, ...], right: tuple[Field, ...]) -> tuple[tuple[str, str], ...]:
    """One-to-one pairs (left name, right name) of the same field, those first that both sides prefer; accepted by the settled score."""
    if not left or not right:
        return ()
    left, right = tuple(Field(*f) for f in left), tuple(Field(*f) for f in right)
    score = {ij: s for ij, s in settled(left, right).items() if s >= ACCEPT and numbers_of(left[ij[0]].name) == numbers_of(right[ij[1]].name)}
    best_a: dict[int, float] = {}
    best_b: dict[int, float] = {}
    for (i, j), s in score.items():
        best_a[i], best_b[j] = max(s, best_a.get(i, 0)), max(s, best_b.get(j, 0))
    ranked = sorted(score, key=lambda ij: (-min(score[ij] / best_a[ij[0]], score[ij] / best_b[ij[1]]), -score[ij], left[ij[0]].name, right[ij[1]].name))
    used_a: set[int] = set()
    used_b: set[int] = set()
    chosen = []
    for i, j in ranked:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            chosen.append((left[i].name, right[j].name))
    return tuple(chosen)
