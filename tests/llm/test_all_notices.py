"""Notices with insertions, deletions and substitutions, side by side, against a plain alignment over all stretches of text."""

import random

from maskwright.llm.license_scan import NOTICES, Scanner


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(1, len(t) - 1)
        kind = rng.randrange(3)
        if t[i] == " " and kind:  # words stay apart
            continue
        t[i : i + (kind > 0)] = [rng.choice("aeiortn")] if kind < 2 else []
    return "".join(t)


def test_every_planted_notice_is_in_some_span():
    rng, scanner, missed, total = random.Random(3), Scanner(), 0, 0
    for _ in range(250):
        filler = lambda: " ".join("".join(rng.choice("bcdfghjklm") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 4)))
        planted, text = [], filler()
        for n in rng.sample(NOTICES, rng.choice([1, 2, 3])):
            with_edits = edited(rng, n.text, rng.randint(0, n.edits))
            text = f"{text} {with_edits} ".lstrip()
            first = len(text.split()) - len(with_edits.split())
            planted.append((n, with_edits, first))
            text += filler()
        spans = scanner.scan(text)[6]
        words = text.split()
        for s in spans:  # what is reported is there, and within its edits
            some = next(n for n in NOTICES if n.label == s["label"] and distance(s["text"], n.text) <= n.edits)
            assert " ".join(words[s["first"] : s["last"] + 1]) == s["text"] and distance(s["text"], some.text) <= s["edits"]
        for n, t, first in planted:
            last = first + len(t.split()) - 1
            total += 1
            missed += not any(s["label"] == n.label and s["first"] <= last and s["last"] >= first for s in spans)
    assert total > 400 and missed == 0
