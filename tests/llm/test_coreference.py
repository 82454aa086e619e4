"""One person, one name; letters stay in their script; hosts and parts are distinct."""

import re
import unicodedata

import pytest

from maskwright.llm import surrogates


def rewritten(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates.with_surrogates(df, "k", **more).collect()}


@pytest.mark.parametrize("map_limit", [10_000, 0])
def test_all_mentions_of_a_person_agree(spark, map_limit):
    out = rewritten(spark, [
        "Mrs. Anna Berg came. Mrs. Anna left. Anna Berg said no. Berg too. The Bergen road.",
        "Dr. Anna Berg and Mr. Carl Berg: Carl, Anna. Zürich",
        "Anna and Berg without a title, and a card 4007276767425962.",
        "Κα Ωμέγα Σίγμα ήρθε. Σίγμα",
    ], map_limit=map_limit)
    first, last = re.match(r"Mrs\. (\w+) (\w+) came", out[0].text).groups()
    assert out[0].text == f"Mrs. {first} {last} came. Mrs. {first} left. {first} {last} said no. {last} too. The Bergen road."
    assert out[0].entity_types == ["name"] * 5 and first.endswith("na") and not last.endswith("na")
    carl = out[1].text.split(" Mr. ")[1].split()[0]
    assert out[1].text == f"Dr. {first} {last} and Mr. {carl} {last}: {carl}, {first}. Zürich" and not carl.endswith("na")
    assert out[2].n_entities == 0 and out[2].text.startswith("Anna and Berg") and "4007276767425962" in out[2].text  # no title; no card by its checksum
    greek = re.fullmatch(r"Κα (\w+) (\w+) ήρθε\. (\w+)", out[3].text).groups()
    assert greek[1] == greek[2] and not {"Σίγμα", "Ωμέγα"} & set(greek) and all(unicodedata.name(c).startswith("GREEK") for w in greek for c in w)


def test_letters_stay_in_their_script(spark):
    words = ["王小明", "Иванов", "Ωμέγα", "ひらがな", "カタカナ", "한국어", "שלום", "سلام", "ไทย", "Straße"]
    out = rewritten(spark, [f"#{w}#" for w in words], patterns={"tag": r"#[^#]+#"})
    for i, w in enumerate(words):
        new = out[i].text.strip("#")
        assert len(new) == len(w) and new != w
        for a, b in zip(w, new, strict=True):
            assert unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0], (w, new)


@pytest.mark.parametrize("map_limit", [0])
def test_hosts_and_parts_are_distinct(spark, map_limit):
    hosts = [f"{a}{b}.org" for a in "abcdefghijklm" for b in "abcdefghijklm"]  # 169 of 676 two-letter hosts
    out = rewritten(spark, [f"to x1y{i}@{h} and Mr. Na{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]} Me" for i, h in enumerate(hosts)], map_limit=map_limit)
    made = [re.search(r"@(\S+)", out[i].text)[1] for i in range(len(hosts))]
    assert len(set(made)) == len(hosts) and not set(made) & set(hosts) and all(m.endswith(".org") and len(m) == 6 for m in made)
    names = {out[i].text.split("Mr. ")[1].split()[0] for i in range(100)}
    assert len(names) == 100 and len({out[i].text.split()[-1] for i in range(100)}) == 1
