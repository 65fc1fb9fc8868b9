"""Licence statements wrapped over lines, within other text, and two in one line."""

import textwrap

from prefixlake.llm import licence_scan

MIT, BSD, GPL = licence_scan.TEMPLATES["mit"][1], licence_scan.TEMPLATES["bsd"][0], licence_scan.TEMPLATES["gpl-3.0"][1]
TALK = "The quick brown fox of the north jumps over a lazy dog and then runs away from it all in the cold evening while others look on."


def test_wrapped_embedded_and_two_licences(spark):
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 60))
    texts = {
        1: (wrap(MIT), ["mit"]), 2: (wrap(BSD, "# "), ["bsd"]), 3: (wrap(GPL, " * "), ["gpl-3.0"]), 4: (wrap(f"{TALK} {MIT}. {TALK}", "// "), ["mit"]),
        5: (f"{wrap(MIT)}\n\n{wrap(BSD)}", ["mit", "bsd"]), 6: ("Released under the MIT License. Licensed under CC BY-SA 4.0.", ["mit", "cc-by-sa"]),
        7: (f"{TALK} " * 20 + MIT + f" {TALK}" * 20, ["mit"]), 8: (f"{TALK}\n{TALK}", []),
    }
    model = licence_scan.train([TALK, "he had to renew the permit for his car"])
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = licence_scan.scan(docs, model).collect()
    for i, (_, want) in texts.items():
        assert sorted(r["family"] for r in got if r["doc_id"] == i and r["confirmed"]) == sorted(want), i
    assert all(r["confirmed"] for r in got)
