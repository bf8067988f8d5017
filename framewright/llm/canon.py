"""Free-typed names mapped to a reference list: a trie of all reference paths, searched with a Levenshtein automaton.

Every reference name and alias enters the trie under each order of its words and each way its letters are written; all paths lead to
the entry's class. Entries of more than four words enter in their own order alone; their other orders are found by the words
they share with the typed name, all but as many as the edits allowed. A typed name is stripped of decoration and read as one run of
letters, however long: the automaton ends by itself where no entry can follow. The search returns all entries within a distance that
depends on the entry's length. The nearest class wins; a tie between classes is reported as ambiguous, never guessed. Names that the
search does not reach are tried as shortened words. The lists are reference data: their size is checked against MAX_ENTRIES and only
then collected. Labels are mapped where they are read, one search per distinct label of a worker, no shuffle.

Defined results: null, empty and letterless names map to nothing; repeated rows map alike; an empty reference list maps nothing; more
than MAX_ENTRIES entries are an error; extra columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.text import ACCENT, FOLD, INVISIBLE
from framewright.operators.skew import spread

MAX_ENTRIES = 100_000
PERMUTED = 4
MOST = 2
CACHE = 200_000
# Words before a colon, and signs of remarks after a name, that are not part of it.
PREFIX = re.compile(r"^\s*(?:class|label|object|obj|name|type|cls)\s*[:=]\s*", re.I)
DASHED, NUMBERED = re.compile(r"\s[-–—]\s"), re.compile(r"\s?#\s?\d*$")
# How German letters are also written.
WRITTEN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
RESULT = "class_id int, distance int, how string"


def limit(length: int) -> int:
    """Edits allowed to a reference entry of so many letters."""
    return 0 if length < 5 else 1 if length < 8 else MOST


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()
    return unicodedata.normalize("NFC", ACCENT.sub("", unicodedata.normalize("NFD", text))).translate(FOLD)


def name_words(text: str) -> list[str]:
    """Letter runs of a name, cut at case changes inside words as in HardHat."""
    text = re.sub(r"(?<=[a-zа-яäöüß])(?=[A-ZА-ЯÄÖÜ][a-zа-яäöüß])", " ", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)))
    return re.findall(r"[^\W\d_]+", plain(text))


def remark_at(text: str) -> int:
    """Where a remark begins (after a dash, in a last pair of brackets, a last number sign); the length of the text if there is none. Blanks are single."""
    at = [m.start() for m in (DASHED.search(text), NUMBERED.search(text)) if m]
    if text and text[-1] in ")]}":
        # The first bracket that opens after the last one closed before.
        after = max(text.rfind(c, 0, len(text) - 1) for c in ")]}") + 1
        opened = [i for c in "([{" if (i := text.find(c, after)) > 0]
        if opened and text[: min(opened)].strip():
            at.append(len(text[: min(opened)].rstrip()))
    return min(at, default=len(text))


def undecorated(label: str) -> str:
    text = PREFIX.sub("", " ".join(unicodedata.normalize("NFKC", INVISIBLE.sub("", label)).split()))
    if m := re.fullmatch(r"[(\[{\"'«](.*?)[)\]}\"'»]", text):
        text = m[1].strip()
    while (at := remark_at(text)) < len(text) and re.search(r"[^\W\d_]", text[:at]):
        text = text[:at]
    return text


class Automaton:
    """States of the Levenshtein automaton of one word with swaps of neighbours, as sparse (position, edits) rows."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self) -> tuple:
        return (), "", tuple((i, i) for i in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple, char: str) -> tuple:
        before, last, row = state
        old, earlier, new = dict(row), dict(before), {}
        far = self.most + 1
        low = max(0, row[0][0] - (row[0][0] > 0)) if row else 0
        for i in range(low, min(len(self.word), row[-1][0] + 1 + self.most) + 1 if row else 0):
            best = old.get(i, far) + 1
            if i:
                best = min(best, old.get(i - 1, far) + (self.word[i - 1] != char), new.get(i - 1, far) + 1)
            if i > 1 and self.word[i - 1] == last and self.word[i - 2] == char:
                best = min(best, earlier.get(i - 2, far) + 1)
            if best <= self.most:
                new[i] = best
        return row, char, tuple(new.items())

    def distance(self, state: tuple) -> int | None:
        return dict(state[2]).get(len(self.word))

    def to(self, other: str) -> int | None:
        """Edits to another word, or None if they are too many."""
        state = self.start()
        for char in other:
            state = self.step(state, char)
        return self.distance(state)


class ReferenceTrie:
    """Paths of letters to sets of class ids; the empty key of a node holds the ids that end there."""

    def __init__(self, entries: list[tuple[str, int]]) -> None:
        self.root: dict = {}
        self.by_size: dict[int, list[tuple[list[str], int]]] = defaultdict(list)
        self.long: list[tuple[list[str], int]] = []
        self.long_with: dict[str, set[int]] = defaultdict(set)
        for name, class_id in entries:
            for written in {name, name.casefold().translate(WRITTEN)}:
                w = name_words(written)
                if not w:
                    continue
                self.by_size[len(w)].append((w, class_id))
                if len(w) > PERMUTED:
                    for x in w:
                        self.long_with[x].add(len(self.long))
                    self.long.append((w, class_id))
                for order in permutations(w) if len(w) <= PERMUTED else [tuple(w)]:
                    node = self.root
                    for char in "".join(order):
                        node = node.setdefault(char, {})
                    node.setdefault("", set()).add(class_id)
        for rows in self.by_size.values():
            rows.sort()

    def within(self, word: str) -> dict[int, int]:
        """class id -> least distance, of all entries within as many edits of the word as their length allows."""
        machine, found = Automaton(word, MOST), {}
        stack = [(self.root, machine.start(), 0)]
        while stack:
            node, state, depth = stack.pop()
            for char, child in node.items():
                if char == "":
                    if (d := machine.distance(state)) is not None and d <= limit(depth):
                        for class_id in child:
                            found[class_id] = min(d, found.get(class_id, d))
                elif (after := machine.step(state, char))[2] or state[2]:
                    stack.append((child, after, depth + 1))
        return found

    def reordered(self, typed: list[str]) -> dict[int, int]:
        """class id -> least distance, of the entries of more than PERMUTED words that have the typed words in any order, up to MOST of them misspelt."""
        found: dict[int, int] = {}
        if len(typed) <= PERMUTED:
            return found
        for i in set().union(*(self.long_with.get(t, set()) for t in typed)):
            w, class_id = self.long[i]
            mine, theirs = Counter(typed) - Counter(w), Counter(w) - Counter(typed)
            if len(w) != len(typed) or mine.total() > MOST:
                continue
            own = list(mine.elements())
            for order in permutations(theirs.elements()):
                apart = [Automaton(a, MOST).to(b) for a, b in zip(own, order, strict=True)]
                if None not in apart and (d := sum(apart)) <= limit(sum(map(len, w))):
                    found[class_id] = min(d, found.get(class_id, d))
        return found

    def shortened(self, typed: list[str]) -> set[int]:
        """Classes of which each word begins with the typed word in its place: three letters of two words and more, four of one."""
        least = 3 if len(typed) > 1 else 4
        if min(map(len, typed)) < least:
            return set()
        rows, out = self.by_size.get(len(typed), []), set()
        for w, class_id in rows[bisect_left(rows, ([typed[0]],)) :]:
            if not w[0].startswith(typed[0]):
                break
            if all(full.startswith(t) for t, full in zip(typed, w, strict=True)):
                out.add(class_id)
        return out

    def read(self, label: str | None) -> tuple[int | None, int | None, str]:
        """(class id, distance, how): how is exact, near, shortened, ambiguous or none."""
        if not isinstance(label, str):
            return None, None, "none"
        typed = name_words(undecorated(label))
        word = "".join(typed)
        if not word:
            return None, None, "none"
        found = self.within(word)
        for class_id, d in self.reordered(typed).items():
            found[class_id] = min(d, found.get(class_id, d))
        if found:
            nearest = min(found.values())
            best = [c for c, d in found.items() if d == nearest]
            return (best[0], nearest, "near" if nearest else "exact") if len(best) == 1 else (None, nearest, "ambiguous")
        short = self.shortened(typed)
        return (short.pop(), 0, "shortened") if len(short) == 1 else (None, None, "ambiguous" if short else "none")


def reference_entries(ref: DataFrame, alias: DataFrame) -> list[tuple[str, int]]:
    """(name or alias, class id); the size is checked before anything is collected."""
    names = ref.where("name is not null and class_id is not null").select("name", F.col("class_id").cast("int").alias("class_id")).distinct()
    paths = alias.where("alias is not null").join(names, F.col("canonical") == F.col("name")).select(F.col("alias").alias("name"), "class_id").distinct()
    rows = names.unionByName(paths).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return sorted((r["name"], r["class_id"]) for r in rows)


#: One trie and its read labels per worker process, by the reference entries; tasks of one worker share it.
_TRIES: dict[int, tuple[ReferenceTrie, dict]] = {}


def worker_trie(entries: list[tuple[str, int]]) -> tuple[ReferenceTrie, dict]:
    key = hash(tuple(entries))
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = (ReferenceTrie(entries), {})
    return _TRIES[key]


def reader(ref: DataFrame, alias: DataFrame):
    """A column function: typed name -> struct(class_id, distance, how)."""
    shared = ref.sparkSession.sparkContext.broadcast(reference_entries(ref, alias))

    @F.pandas_udf(f"struct<{RESULT.replace(' int', ':int').replace(' string', ':string')}>")
    def read(labels: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, known = worker_trie(shared.value)
        for part in labels:
            for label in part.dropna().unique():
                if label not in known:
                    if len(known) >= CACHE:
                        known.clear()
                    known[label] = trie.read(label)
            rows = [known.get(x) or trie.read(x) if isinstance(x, str) else (None, None, "none") for x in part]
            out = pd.DataFrame(rows, columns=["class_id", "distance", "how"])
            yield out.astype({"class_id": "Int32", "distance": "Int32"})

    return read


def mapped(names: DataFrame, column: str, ref: DataFrame, alias: DataFrame) -> DataFrame:
    """Add class_id, distance and how to rows with a typed name."""
    return names.withColumn("_m", reader(ref, alias)(F.col(column))).select(*names.columns, "_m.*") if "class_id" not in names.columns else names.withColumn("ref", reader(ref, alias)(F.col(column)))


def meant(names: DataFrame, record: Column, label: Column, origin: str, ref: DataFrame, alias: DataFrame) -> DataFrame:
    """origin, record_id, class_id of names that mean a reference class without being its exact name."""
    rows = names.select(record.cast("long").alias("record_id"), label.alias("label")).where("label is not null")
    # Only inputs with too few splits are moved; a label then goes to at most four tasks, which share its search.
    rows = spread(rows.withColumn("_salt", F.pmod("record_id", F.lit(4))), ["label", "_salt"]).drop("_salt")
    exact = ref.select(F.col("name").alias("label"), F.col("class_id").alias("_exact")).where("label is not null").distinct()
    got = mapped(rows, "label", ref, alias).where("class_id is not null").join(F.broadcast(exact), "label", "left_anti")
    return got.select(F.lit(origin).alias("origin"), "record_id", "class_id").distinct()


def unmatched(names: DataFrame, ref: DataFrame, alias: DataFrame) -> DataFrame:
    """origin, label, rows and how, of the names (origin, label) that mean no class (none) or more than one (ambiguous)."""
    counted = names.groupBy("origin", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    return mapped(counted, "label", ref, alias).where("class_id is null").select("origin", "label", "n_rows", "how")


def new_class_map(classes: DataFrame, ref: DataFrame, alias: DataFrame) -> DataFrame:
    """Per data set: each old class id and name, and the reference class it becomes (null: it means none)."""
    got = mapped(classes.where("dataset is not null and cls_id is not null").select("dataset", "cls_id", "name").distinct(), "name", ref, alias)
    return got.select("dataset", F.col("cls_id").alias("old_id"), F.col("name").alias("old_name"), F.col("class_id").alias("new_id"))
