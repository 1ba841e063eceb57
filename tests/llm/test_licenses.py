"""The licence classifier on paragraphs it was not trained on."""

import numpy as np
import pytest

from tracewell.llm import licenses as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.sample_paragraphs(spark.read.parquet(f"{SF}/documents.parquet"), 600))


def test_unseen_variants_of_notices(model):
    rng = np.random.default_rng(99)
    right = total = 0
    for family, templates in L.TEMPLATES.items():
        for text in templates:
            words = L.paragraph_words(text)
            for _ in range(5):
                kept = [w for w in words if rng.random() > 0.05]
                found, _, similarity = model.classify(" ".join(kept))
                right += found == family
                total += 1
    assert right / total >= 0.9
    for family, templates in L.TEMPLATES.items():
        for text in templates:
            found, _, similarity = model.classify(f"Note. {text} And more.")
            assert (found, similarity) == (family, 1.0)


def test_every_notice_line_and_nothing_else(spark, model):
    starts = ("Licensed under", "Released under", "This work is licensed")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in L.licence_scan(docs, model).collect():
        assert (r.n_confirmed > 0) == any(line.startswith(starts) for line in texts[r.doc_id].split("\n"))
        assert r.n_paragraphs == sum(bool(line.strip()) for line in texts[r.doc_id].split("\n"))


def test_ordinary_text_is_unknown(model):
    for text in ("The license of my car has expired.", "Permission to land was given at noon.", "version 2", "the", "", "Thatlyre onandin the of.", "under the terms"):
        assert model.classify(text)[0] == L.UNKNOWN


def test_edge_cases(spark, model):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, f"\n\n{notice}\n", 1), (3, f"\n\n{notice}\n", 1), (None, notice, 1), (4, "word " * 80_000 + "\n" + notice, 1)], "doc_id long, text string, families int")
    rows = sorted(map(tuple, L.licence_scan(docs, model).collect()), key=str)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == 6
    assert by_id[1][1:5] == by_id[2][1:5] == (0, 0, 0, "")
    assert by_id[3][1:5] == by_id[None][1:5] == (1, 1, 1, "mit") and by_id[3][5].startswith("2:mit:")
    assert by_id[4][1:5] == (2, 1, 1, "mit")
    assert L.licence_scan(docs.limit(0), model).count() == 0
    assert L.train([]).classify(notice)[0] == "mit"


def test_softmax_probabilities_are_a_distribution(model):
    p = model.probabilities(L.paragraph_words("Licensed under the Apache License"))
    assert abs(p.sum() - 1) < 1e-9 and len(p) == len(L.TEMPLATES) + 1


@pytest.mark.parametrize(
    "text",
    [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is licensed under the GNU Library General Public License, version 2.",
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    ],
)
def test_other_licences_are_never_confirmed_as_a_known_one(model, text):
    family, _, similarity = model.classify(text)
    assert family == L.UNKNOWN or similarity < L.CONFIRM


def test_sample_is_bounded_and_takes_rows_without_id(spark):
    rows = [(i if i % 3 else None, f"An ordinary line of text number {i}\n" + "x" * 50) for i in range(900)] + [(None, None), (5000, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = L.sample_paragraphs(docs, 200)
    assert len(lines) == 200 and all(line.startswith("An ordinary") for line in lines)
    assert 40 <= sum(int(line.rsplit(" ", 1)[1]) % 3 == 0 for line in lines) <= 95
    assert L.sample_paragraphs(docs, 200) == lines
    assert L.sample_paragraphs(docs.limit(0), 5) == []


def _among(text, rng, count):
    """The notice somewhere in ``count`` words of the given documents' kind."""
    others = list(rng.choice("the of data a system in model text to with river and for water under this license free".split(), count))
    at = int(rng.integers(0, count + 1))
    return " ".join(others[:at] + [text] + others[at:])


@pytest.mark.parametrize("count", [5, 20, 100, 5000])
def test_notices_in_long_lines(model, count):
    rng = np.random.default_rng(count)
    right = total = 0
    for family, templates in L.TEMPLATES.items():
        for text in templates:
            confirmed = {f for f, _, s in model.findings(_among(text, rng, count)) if s >= L.CONFIRM}
            assert confirmed <= {family}
            right += confirmed == {family}
            total += 1
    assert right / total >= 0.9


def test_two_notices_in_one_line_and_other_versions_among_words(model):
    rng = np.random.default_rng(1)
    both = _among("Released under the MIT License.", rng, 60) + " " + _among("Licensed under CC BY 4.0.", rng, 60)
    assert {f for f, _, s in model.findings(both) if s >= L.CONFIRM} == {"mit", "cc-by-4.0"}
    assert L.scan_text(both, model)[:4] == (1, 1, 1, "cc-by-4.0,mit")
    for other in ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 4.0."):
        assert not [f for f in model.findings(_among(other, rng, 200)) if f[2] >= L.CONFIRM]
