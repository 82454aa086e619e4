"""Adjacent notices of a kind with different numbers of edits."""

import itertools

import pytest

from maskwright.llm import license_scan


@pytest.mark.parametrize("n", [2, 3])
def test_adjacent_notices_are_all_found(n):
    forms = ["licensed under the apache license", "licensed under the apache licence", "licenced under the apache licence"]
    scanner = license_scan.Scanner()
    for some in itertools.product(range(3), repeat=n):
        for between in (" ", " and "):
            text = "x " + between.join(forms[i] for i in some) + " y"
            spans = [s for s in scanner.scan(text)[6] if s["label"] == "apache"]
            assert [(s["edits"], s["text"]) for s in spans] == [(i, forms[i]) for i in some], text
