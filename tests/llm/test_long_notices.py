"""Very long texts full of notices: linear time, and the same findings as in pieces."""

import random
import time

from maskwright.llm.license_scan import NOTICES, Scanner


def test_time_is_in_proportion_to_the_text():
    scanner, seconds = Scanner(), []
    for n in (20_000, 80_000):
        text = "all rights reservd " * n
        start = time.process_time()
        spans = [s for s in scanner.scan(text)[6] if s["label"] == "proprietary"]
        seconds.append(time.process_time() - start)
        assert len(spans) == n and [s["first"] for s in spans] == list(range(0, 3 * n, 3))
    assert seconds[1] < 8 * seconds[0]


def test_every_notice_of_a_long_text_is_found():
    rng, scanner, planted, text = random.Random(8), Scanner(), [], ""
    words = 0
    parts = []
    for _ in range(4000):
        n = rng.choice(NOTICES)
        planted.append((n.label, words, words + len(n.text.split()) - 1))
        parts.append(n.text.replace("license", "licence") if n.edits > 1 and n.text.count("license") == 1 else n.text)
        words += len(n.text.split())
        filler = ["blk"] * rng.randint(0, 3)
        parts += filler
        words += len(filler)
    text = " ".join(parts)
    by: dict[str, list] = {}
    for s in scanner.scan(text)[6]:
        by.setdefault(s["label"], []).append((s["first"], s["last"]))
    covered = {label: {w for a, b in spans for w in range(a, b + 1)} for label, spans in by.items()}
    assert all(covered[label] & set(range(a, b + 1)) for label, a, b in planted)
