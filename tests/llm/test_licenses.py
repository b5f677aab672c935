from collections import defaultdict

import pytest

from assayer.llm import licenses
from assayer.llm.queries import op9_license_scan
from tests.llm.cases import ODD, PROSE, documents

#: Notices as the table holds them.
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Released under the MIT License.": "mit",
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_license_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    want = defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if line.strip() in NOTICES:
                want[d].add(NOTICES[line.strip()])
    for r in rows:
        assert (r.family in want[r.doc_id]) if want[r.doc_id] else r.family is None, r


def test_families_and_others(spark, model):
    notices = [(i, PROSE + "\n" + t + "\n" + PROSE) for i, (t, _) in enumerate(NOTICES.items())]
    others = ["The general took the version of the public story under his license to kill", "My apache friend released a free bird in the spring", PROSE]
    docs = documents(spark, [*notices, *((100 + i, t) for i, t in enumerate(others))])
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    assert [got[i].family for i in range(4)] == list(NOTICES.values())
    assert all(got[100 + i].family is None for i in range(3))
    assert got[0].n_paragraphs == 3 and got[0].n_licenses == 1


#: None of these names is in the training texts.
UNSEEN = ["Provided under the terms of the Zope Public License, version 2.1.", "Licensed under the Sleepycat License.", "Released under the Ruby Licence"]


def test_unknown_licences(spark, model):
    seen = ["Provided under the terms of the ISC licence.", "Boost Software License, Version 1.0", "Licensed under the EUPL version 1.2"]
    docs = documents(spark, [(i, f"{PROSE}\n{t}\n{PROSE}") for i, t in enumerate(seen + UNSEEN)])
    for r in licenses.scan(docs, model).collect():
        assert (r.n_paragraphs, r.n_licenses, r.n_unknown, r.family) == (3, 0, 1, None), r


def test_counts_against_single_documents(spark, model):
    """Every document alone gives the row that it has in the table, however often rows are repeated."""
    text = PROSE + "\n" + "\n".join(NOTICES) + "\n" + UNSEEN[0]
    texts = [(1, text), (1, text), (1, PROSE), (2, text), (None, text), (None, text), (3, "Released under the MIT License.")]
    got = sorted(map(tuple, licenses.scan(documents(spark, texts), model).collect()), key=str)
    alone = [tuple(licenses.scan(documents(spark, [t]), model).first()) for t in texts]
    assert got == sorted(alone, key=str)
    assert [r[2:4] for r in alone[:2]] == [(4, 1), (4, 1)]


def test_odd_rows(spark, model):
    every = licenses.scan(documents(spark, ODD), model).collect()
    assert len(every) == len(ODD)
    rows = {r.doc_id: r for r in every}
    assert set(rows) == {d for d, _ in ODD}
    assert rows[3].n_paragraphs == rows[4].n_paragraphs == rows[5].n_paragraphs == 0
    assert rows[9].n_paragraphs == 900
    assert licenses.scan(documents(spark, []), model).count() == 0
    assert licenses.fit(documents(spark, [])).least >= 0.5


def test_notices_of_a_hot_source_do_not_set_the_threshold(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    own = "Proprietary and confidential, unauthorized copying is prohibited"
    docs = documents(spark, [(i, f"{PROSE}\n{' '.join(PROSE.split()[i % 9 :])}\n{bsd if i % 2 else own}") for i in range(400)])
    model = licenses.fit(docs)
    assert model.least < 0.6
    rows = licenses.scan(docs, model).collect()
    assert all((r.family, r.n_licenses) == ("bsd-3-clause" if r.doc_id % 2 else "proprietary", 1) for r in rows)


def test_threshold_covers_every_paragraph(spark):
    odd = "The mozilla public garden is licensed under the creative commons of the GNU and Apache people"
    texts = [(i, PROSE) for i in range(300)] + [(1000 + i, odd) for i in range(30)]
    model = licenses.fit(documents(spark, texts), sample=0)
    (high,) = licenses._scored(documents(spark, [(1, odd)]), model).collect()
    assert 1 - high.p[0] > 0.52
    assert 0 <= model.least - (1 - high.p[0]) <= 1e-5
