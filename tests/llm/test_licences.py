"""Whole licence texts in the forms in which hosting sites and distributions write them."""

import os

import pytest

from cohortry.llm import licences
from cohortry.llm.licence_texts import DIGESTS, TEXTS

SYSTEM = "/usr/share/common-licenses"  # texts of the operating system, where it has them
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licences.scan(df, licences.known(spark)).collect()
    return [r["licence"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_titles_and_copyright_lines(spark):
    for name, text in TEXTS:
        forms = [
            f"{name} License\n\nCopyright (c) 2019 Ann Example\n\n{text}",
            f"The {name} License ({name})\n\nCopyright (c) Ann Example\nCopyright 2020 Bob\n\n{text}\n",
            f"Copyright Ann Example <ann@example.org>\nAll rights reserved.\n\n{text}",
            f"({name} Licence)\r\n\r\n© 2021 Ann\r\n{text}",
        ]
        assert found(spark, forms) == [name] * len(forms)


def test_other_texts_stay_unknown(spark):
    mit = dict(TEXTS)["MIT"]
    others = [mit + "\nAnd no Sundays.", mit.replace("without restriction", "with restriction"), "MIT License\n", "All rights reserved by the cat.", "", None]
    assert found(spark, others) == [None] * len(others)


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence texts on this machine")
def test_digests_of_long_licences(spark):
    here = {name: licence for name, licence in FILES.items() if os.path.exists(f"{SYSTEM}/{name}")}
    texts = [open(f"{SYSTEM}/{name}", encoding="utf-8", errors="replace").read() for name in here]
    assert found(spark, texts) == list(here.values())
    assert {name for name, _ in DIGESTS} == set(FILES.values())
