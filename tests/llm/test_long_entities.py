"""Entities of several hundred characters leave no rest."""

import random

from maskwright.llm import surrogates


def test_nothing_of_a_long_value_stays(spark):
    rng = random.Random(13)
    draw = lambda n, a="ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz": "".join(rng.choice(a) for _ in range(n))
    values = {}
    for i, n in enumerate((20, 81, 129, 172, 700)):
        for j, lead in enumerate(("secret=", "token: ", "password=", "ghp_", "sk-")):
            values[100 * i + j] = (f"so {lead}{{}} end", draw(n), "secret")
    for i, n in enumerate((5, 65, 300)):
        values[1000 + i] = ("mail <{}@example.com>", draw(n), "email")
        values[1010 + i] = ("call +49 123 4567{}@example.org now", draw(n), "email")
        values[1020 + i] = ("Mr. {} went", "B" + draw(n, "abcdefghjkm"), "name")
    df = spark.createDataFrame([(k, lead.format(v)) for k, (lead, v, _) in values.items()] + [(5000, "x." * 20000), (5001, "a" * 40000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in surrogates.with_surrogates(df, "k").collect()}
    for k, (lead, v, kind) in values.items():
        assert rows[k].entity_types[-1] == kind, lead
        assert not any(v[i : i + 5] in rows[k].text for i in range(len(v) - 4)), (lead, len(v))
    assert rows[5000].n_entities == rows[5001].n_entities == 0
