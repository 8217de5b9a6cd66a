import random
import re

import pytest

from tokentally.llm import license_scan as ls
from tokentally.llm.license_texts import TEMPLATES

#: The notices of the sample tables.
PLANTED = {
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "Proprietary",
}


@pytest.fixture(scope="module")
def templates():
    return ls.Templates()


def notices(templates, text):
    """(line, license, differences) of the notices of one text."""
    found = []
    for start, block in ls.blocks(text):
        result = ls.judgement(templates, "\n".join(block))
        if result:
            license_, _, _, differences, low, high, right = result
            found.append((right, start + low, start + high, license_, differences))
    kept = ls.without_overlaps([(*f[:3], k) for k, f in enumerate(found)])
    return sorted((found[k][1], *found[k][3:]) for k in kept)


def test_query_finds_the_lines_of_the_tables(spark, tables):
    from tokentally.llm.catalogue import QUERIES

    folder = tables.replace("sf0.001", "sf0.01")
    expected = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for line, text in enumerate(r.text.split("\n")):
            if text.strip() in PLANTED:
                expected.append((r.doc_id, line, PLANTED[text.strip()], 0))
    got = [(r.doc_id, r.line, r.license, r.differences) for r in QUERIES["op2_license_scan"](spark, folder).collect()]
    assert sorted(got) == sorted(expected) and expected


@pytest.mark.parametrize("place", range(len(TEMPLATES)))
def test_each_template_is_found_whole_wrapped_and_changed(templates, place):
    name, text = TEMPLATES[place]
    wrapped = re.sub(r"((?:\S+\s+){9}\S+)\s", r"\1\n", text)
    for variant in (text, text.upper(), wrapped):
        found = list(notices(templates, f"Some words before.\n{variant}\n\nand after."))
        assert [f[1] for f in found] == [name] and found[0][2] == 0
    long = ls.words(text)
    if len(long) >= 16:
        changed = text.replace(long[len(long) // 2], "other", 1)
        found = list(notices(templates, changed))
        assert [f[1] for f in found] == [name]


def test_notices_within_long_lines(spark):
    filler = "plain words of a longer line that tell of something else "
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [
        (1, "Copyright 2024 Example Corporation and its affiliates, Springfield. All rights reserved."),
        (2, filler * 2 + mit + " " + filler * 2),
        (3, filler * 40 + mit + " " + filler + cc + " " + filler * 40),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.license, r.notice) for r in ls.scan_licenses(docs).collect())
    assert got == [
        (1, 0, "Proprietary", "All rights reserved"), (2, 0, "MIT", mit[:-1]),
        (3, 0, "CC-BY-NC-4.0", cc[:-1]), (3, 0, "MIT", mit[:-1]),
    ]


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause"])
def test_paragraphs_of_one_license(templates, name):
    text = dict(TEMPLATES)[name]
    apart = text.replace("are met: ", "are met:\n\n").replace(". ", ".\n\n")
    assert apart.count("\n\n") >= 2
    assert notices(templates, f"Some words before.\n\n{apart}\n\nand after.") == [(2, name, 0)]


def test_other_talk_of_licenses_is_not_a_notice(templates):
    for text in ("The license plate was lost.", "Copyright law is old.", "Please license your dog and the cat of the house."):
        assert list(notices(templates, text)) == []


def test_compression_ranks_the_right_template(templates):
    *saved, alone = templates.saved(TEMPLATES[3][1]).tolist()
    assert max(range(len(saved)), key=saved.__getitem__) == 3 and saved[3] > 0.8 * alone


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "All rights reserved."), (3, "All rights reserved."), (None, "Released under the MIT License."),
        (4, "word " * 100_000 + "\n" + "All rights reserved.\n" * 3), (5, "licens " * 2000),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.line, r.license) for r in ls.scan_licenses(docs).collect()), key=str)
    assert got == sorted(
        [(3, 0, "Proprietary")] * 2 + [(None, 0, "MIT")] + [(4, k, "Proprietary") for k in (1, 2, 3)], key=str
    )
    assert ls.scan_licenses(docs.limit(0)).collect() == []


def test_no_template_within_the_differences_allowed_saves_too_little():
    """As many words replaced as the bound allows, between words that do not compress."""
    chance = random.Random(1)
    other = lambda: "".join(chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chance.randrange(2, 12)))
    prepared = ls.Templates()
    for k, (_, text) in enumerate(ls.TEMPLATES):
        for _ in range(20):
            own = text.split()
            edits = len(own) // ls.WORDS_PER_DIFFERENCE
            for j in range(edits):
                own[int((j + chance.random()) * len(own) / edits)] = other()
            block = [other() for _ in range(edits + 2)] + own + [other() for _ in range(edits + 2)]
            *saved, alone = prepared.saved(" ".join(block)).tolist()
            assert saved[k] > 1.8 * ls.LEAST_SAVED * alone, text
