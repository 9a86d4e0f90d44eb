import random
import time

import pytest

from pagemill.llm import licenses, queries
from pagemill.llm.licenses import TEMPLATES, Scanner

SCANNER = Scanner(TEMPLATES)


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def found(text):
    return [(x.license, x.confirmed) for x in SCANNER.scan(text)]


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_every_template_is_found_at_the_end_and_in_prose(name):
    rng, t = random.Random(3), TEMPLATES[name].rstrip(":.")
    for tail in ("", ".", ".\n" + filler(rng, 100)):
        start = filler(rng, rng.randint(3, 140))
        text = f"{start}.\n{t.upper() if tail else t}{tail}"
        hits = [x for x in SCANNER.scan(text) if x.confirmed]
        assert [(x.license, x.differences) for x in hits] == [(name[0], 0)]
        assert text[hits[0].start :].lower().startswith(t.lower()[:12]) and hits[0].end <= len(start) + 2 + len(t) + 1


CASES = [
    ("This work is licensed under the GNU General Public License, version 2.", [("GPL-2.0", True)]),
    ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", True)]),
    (TEMPLATES["GPL-2.0-or-later", "notice"], [("GPL-2.0-or-later", True)]),
    (TEMPLATES["LGPL-2.1-or-later", "notice"], [("LGPL-2.1-or-later", True)]),
    (TEMPLATES["AGPL-3.0-or-later", "notice"], [("AGPL-3.0-or-later", True)]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", [("CC-BY-NC-ND-4.0", True)]),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", [("CC-BY-3.0", True)]),
    ("Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", True)]),
    (TEMPLATES["BSD-3-Clause", "text"], [("BSD-3-Clause", True)]),
    (TEMPLATES["BSD-2-Clause", "text"], [("BSD-2-Clause", True)]),
    (licenses.BSD, [("LicenseRef-BSD", True)]),
    (licenses.ISC, [("ISC", True)]),
    (licenses.MPL, [("MPL-2.0", True)]),
    ("// SPDX-License-Identifier: GPL-2.0-only", [("GPL-2.0-only", True)]),
    ("Copyright Ada. All rights reserved.", [("LicenseRef-all-rights-reserved", True)]),
    ("Released under the MIT License. Then text. Released under the MIT License.", [("MIT", True), ("MIT", True)]),
    ("Released under the MIT License. " + licenses.APACHE, [("MIT", True), ("Apache-2.0", True)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_names(text, want):
    assert found(text) == want
    assert found("Some words come before. " + text + "\nAnd some after it.") == want


@pytest.mark.parametrize("text", ["Not all rights reserved here", "This is not licensed under the MIT License", "Licensed under the GNU General Public License, version 4", "This work is licensed under a Creative Commons Attribution 5.0 International License"])
def test_near_misses_have_a_flag(text):
    assert found(text) and not any(sure for _, sure in found(text))


def test_differences_are_counted_and_bounded():
    changed = licenses.GRANT.replace("free of charge", "free of any charge").replace("sublicense", "sub license")
    (hit,) = SCANNER.scan("intro words " + changed + " more words")
    assert hit.license == "MIT" and hit.confirmed and hit.differences > 0
    assert SCANNER.scan("This license is unlike any other: do as thou wilt with these few lines of verse.") == []


def test_against_trying_every_template_everywhere():
    """Brute force: every template aligned with every run of words of its length must agree on exact notices."""
    rng = random.Random(7)
    names = [n for n in TEMPLATES if len(SCANNER.words[n]) <= 60]
    for _ in range(25):
        chosen = rng.choices(names, k=3)
        text = " ".join(x for n in chosen for x in (filler(rng, rng.randint(0, 30)), TEMPLATES[n]))
        words = [w for w, *_ in licenses.words_of(text)]
        exact = {n for n in names for i in range(len(words)) if words[i : i + len(SCANNER.words[n])] == SCANNER.words[n]}
        got = [x for x in SCANNER.scan(text) if x.confirmed]
        assert [x.license for x in got] == [n[0] for n in chosen]
        assert {(x.license, x.wording) for x in got} <= exact


def test_many_notices_take_time_in_proportion():
    rng = random.Random(1)
    took = []
    for n in (500, 2000):
        text = "\n".join("Released under the MIT License. " + filler(rng, 5) for _ in range(n))
        began = time.process_time()
        assert len(SCANNER.scan(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 30


def test_query_and_odd_inputs(spark, tmp_path):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "no notice"), (None, line), (5, line), (5, line), (6, "word " * 300_000 + line)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, license string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_licenses(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.license, r.differences) for r in got) == [(-1, "MIT", 0), (5, "MIT", 0), (5, "MIT", 0), (6, "MIT", 0)]
    assert max(r.start for r in got) == 5 * 300_000
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
