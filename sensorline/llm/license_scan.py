"""License scan: exact phrases by words, and fuzzy search for short notices.

A notice of n characters with at most k edits holds one of its k + 1 pieces unchanged (pigeonhole), so an exact search for
all pieces finds every candidate place. Around each, the regex library's bounded-error matching verifies the edits and
gives the span. Notices are sought in lower-cased text with runs of white space and signs folded to one space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES

#: Phrases and labels of the base search (fixed values).
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices and labels of the fuzzy search (fixed values: wording of public licences).
NOTICES: dict[str, str] = {
    "licensed under the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "licensed under cc by": "cc-by",
    "creative commons attribution 4 0 international": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}
#: Characters of a notice for each edit allowed.
PER_EDIT = 10


class Notices:
    """Seeds of all notices in one automaton, and a fuzzy pattern for each notice."""

    def __init__(self, notices: dict[str, str] = NOTICES, per_edit: int = PER_EDIT):
        import regex

        self.labels, self.patterns, self.sizes, self.edits = [], [], [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            k = len(notice) // per_edit
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[begin:end], []).append((i, begin))
            self.labels.append(label)
            self.sizes.append(len(notice))
            self.edits.append(k)
            self.patterns.append(regex.compile(rf"(?be)({regex.escape(notice, literal_spaces=True)}){{e<={k}}}"))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of notices in folded text: of places of one notice that overlap the one with the
        fewest edits, then the leftmost. Each seed's window is searched on its own, so neighbours cannot hide one another."""
        windows: set[tuple[int, int]] = set()
        for end, (size, places) in self.seeds.iter(text):
            windows.update((i, end + 1 - size - offset) for i, offset in places)
        matches: dict[int, set[tuple[int, int, int]]] = {}
        for i, begin in windows:
            low, high = max(0, begin - self.edits[i]), min(len(text), begin + self.sizes[i] + self.edits[i])
            if m := self.patterns[i].search(text, low, high):
                matches.setdefault(i, set()).add((sum(m.fuzzy_counts), m.start(), m.end()))
        found = []
        for i, own in matches.items():
            begins: list[int] = []
            ends: list[int] = []
            for edits, begin, end in sorted(own):
                at = bisect_right(begins, begin)
                if (at and ends[at - 1] > begin) or (at < len(begins) and begins[at] < end):
                    continue
                begins.insert(at, begin)
                ends.insert(at, end)
                found.append((begin, end, self.labels[i], edits))
        return sorted(found)


def fold(data: bytes) -> tuple[str, np.ndarray]:
    """Text with what is no word folded to one space, and the code point of the original for each of its characters."""
    raw = np.frombuffer(data, np.uint8)
    word = np.frombuffer(data.translate(WORD_BYTES), np.uint8)
    blank = word == 0x20
    keep = ~blank | np.concatenate([[False], ~blank[:-1]])
    first = (raw & 0xC0) != 0x80  # first byte of a code point
    place = np.cumsum(first) - 1
    return word[keep].tobytes().decode("utf-8", "surrogatepass"), place[keep & first]


@lru_cache(maxsize=2)
def _notices(notices: tuple[tuple[str, str], ...]) -> Notices:
    return Notices(dict(notices))


def folded_notice(text: str) -> str:
    """A notice as it is sought: words in lower case with one space between them."""
    return fold(text.encode())[0].strip()


def spdx_notices(ids: list[str]) -> dict[str, str]:
    """Notices for licence identifiers: the tag line that names each, labelled with the identifier in lower case."""
    return {folded_notice(f"SPDX-License-Identifier: {i}"): i.lower() for i in ids}


def base_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    out = []
    for phrase, label in phrases.items():
        want = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(want[0], at + 1)
                if words[at : at + len(want)] == want:
                    out.append((at, label))
        except ValueError:
            pass
    return sorted(out)


#: Every phrase holds one of these; texts without any have no base place.
_ANCHOR = re.compile(rb"\x20(?:license|by)\x20")


def scan_text(text: str | None, notices: Notices | None = None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """Word count, base places, and notices (start, end in code points of the original, label, edits) of a whole text."""
    if not text:
        return 0, [], []
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(WORD_BYTES).split()
    folded, place = fold(data)
    base = base_places(words) if _ANCHOR.search(b" " + b" ".join(words) + b" ") else []
    found = (notices or _notices(tuple(NOTICES.items()))).find(folded)
    return len(words), base, [(int(place[s]), int(place[e - 1]) + 1, label, n) for s, e, label, n in found]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())])
PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each document: doc_id, n_words, base (word, label) and notices (start, end, label, edits).

    notices: folded text (folded_notice) and label of what is sought with errors; hundreds of them make one automaton.
    A null text counts as empty. Rows are scanned one by one: nothing is shuffled, and repeated rows stay.
    """

    wanted = tuple(notices.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _notices(wanted)
        for batch in batches:
            n, base, found = zip(*(scan_text(t.as_py(), own) for t in batch.column("text")), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()),
                    pa.array([[{"word": w, "label": k} for w, k in x] for x in base], pa.list_(PLACE)),
                    pa.array([[dict(zip(("start", "end", "label", "edits"), y, strict=True)) for y in x] for x in found], pa.list_(SPAN)),
                ],
                names=["doc_id", "n_words", "base", "notices"],
            )

    shape = "doc_id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, notices array<struct<start:bigint,end:bigint,label:string,edits:int>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape)


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of a scan; score is 1 for an exact phrase or notice, less a tenth for each edit of the best notice.

    notice_spans has label:start:end:edits of every notice by start, comma-joined; code points, end exclusive.
    """
    label = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_min(F.transform("notices", lambda x: x["edits"]))
    score = F.when(F.size("base") > 0, 1.0).when(best.isNull(), 0.0).otherwise(F.greatest(F.lit(0.1), 1.0 - 0.1 * best))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        joined(label("base")).alias("base_labels"), joined(F.concat(label("base"), label("notices"))).alias("labels"),
        score.cast("double").alias("score"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"])), ",").alias("notice_spans"),
    )
