"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice that may hold k edits is cut into k + 1 pieces; one of them at least stands in the text unchanged.  An Aho-Corasick
automaton over all pieces finds these seeds in one pass, and around each the regex library's bounded-error matching
decides and gives the edits.  Both work on the text's lower-cased words joined by single spaces, so line breaks and punctuation
do not count as edits; spans are given in words.  One Arrow pass, no shuffle.

Defined results: null, empty and wordless texts have no words and no finding, score 0; texts are scanned whole, however long; empty tables give empty
ones; input columns named like the added ones give way to them; repeated rows are scanned each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import without, words_of

#: phrases whose exact places are counted, with their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int


#: short notices, searched with edits
NOTICES = (
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("apache", "licensed under the apache license", 3),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("cc-by", "licensed under cc by", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("proprietary", "all rights reserved", 2),
    Notice("unlicense", "free and unencumbered software released into the public domain", 4),
    Notice("gfdl", "gnu free documentation license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("eupl", "european union public licence", 2),
    Notice("cddl", "common development and distribution license", 3),
    Notice("boost", "boost software license", 2),
    Notice("artistic", "licensed under the artistic license", 3),
    Notice("ofl", "sil open font license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 4),
    Notice("cc0", "creative commons zero", 1),
    Notice("public-domain", "dedicated to the public domain", 2),
)

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,first:long,last:long,edits:int,text:string>>, score double"


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        self.seeds = ahocorasick.Automaton()
        wanted: dict[str, list[tuple]] = defaultdict(list)
        for phrase, label in phrases.items():
            wanted[f" {phrase} "].append(("base", label, len(phrase.split())))
        self.patterns = []
        for i, n in enumerate(notices):
            pieces, cuts = n.edits + 1, len(n.text)
            for k in range(pieces):
                a, b = k * cuts // pieces, (k + 1) * cuts // pieces
                wanted[n.text[a:b]].append(("seed", i, a))
            self.patterns.append(regex.compile(rf"\b(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}\b", regex.BESTMATCH))
        for seed, uses in wanted.items():
            self.seeds.add_word(seed, (len(seed), tuple(uses)))
        self.seeds.make_automaton()
        self.notices = notices

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        places: list[tuple[int, str]] = []
        around: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, uses) in self.seeds.iter(line):
            start = end - size + 1
            for kind, what, more in uses:
                if kind == "base":
                    places.append((start + 1, what))
                else:
                    n = self.notices[what]
                    a = max(0, start - more - n.edits)
                    around[what].append((a, min(len(line), start - more + len(n.text) + n.edits + 1)))
        spans = []
        for what, windows in around.items():
            for a, b in _joined(windows):
                for m in _matches(self.patterns[what], line, a, b, len(self.notices[what].text) + 2 * self.notices[what].edits + 2):
                    found = m.group().strip()
                    at = m.start() + m.group().index(found[:1]) if found else m.start()
                    spans.append({"label": self.notices[what].label, "first": at, "last": found.count(" "), "edits": sum(m.fuzzy_counts), "text": found, "size": len(self.notices[what].text)})
        number = _word_numbers(line, [p for p, _ in places] + [s["first"] for s in spans])
        places = [(number[p], what) for p, what in places]
        for s in spans:
            s["first"] = number[s["first"]]
            s["last"] += s["first"]
        spans.sort(key=lambda s: (s["first"], s["last"], s["label"]))
        score = 1.0 if places else max((1 - s["edits"] / s["size"] for s in spans), default=0.0)
        for s in spans:
            del s["size"]
        starts = [p for p, _ in places]
        base = sorted({x for _, x in places})
        labels = sorted({*base, *(s["label"] for s in spans)})
        return len(words), len(places), min(starts, default=None), max(starts, default=None), base, labels, spans, round(score, 6)


BLOCK = 8  #: greatest lengths of a match that are searched at once


def _matches(pattern: regex.Pattern, line: str, a: int, b: int, reach: int) -> Iterator[regex.Match]:
    """Matches of which none overlaps another, so that every stretch that matches overlaps one.

    In a block of the slice the best match, and in turn those of what lies before and behind it, until nothing is found.  Blocks overlap by ``reach``, which no match
    exceeds, but for what matched already; so the time is in proportion to the slice, however many notices stand in it.
    """
    while a < b:
        stop = min(b, a + BLOCK * reach)
        left, end = [(a, stop)], a
        while left:
            x, y = left.pop()
            if y > x and (m := pattern.search(line, x, y)):
                yield m
                left += [(x, m.start()), (m.end(), y)]
                end = max(end, m.end())
        a = b if stop == b else max(end, stop - reach)


def _word_numbers(line: str, places: list[int]) -> dict[int, int]:
    """The number of the word at each place, by one walk over the line."""
    out, seen, last = {}, 0, 0
    for p in sorted(set(places)):
        seen += line.count(" ", last, p)
        last = p
        out[p] = seen - 1
    return out


def _joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """All columns of ``docs`` and what ``FOUND`` lists."""
    names = [c.split()[0] for c in FOUND.replace("<", " <").split(", ")]
    docs = without(docs, *names)

    @F.pandas_udf(FOUND)
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for p in parts:
            out = pd.DataFrame([scanner.scan(t) for t in p], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("__found", scanned(F.col(text))).select(*docs.columns, "__found.*")
