"""Whole licenses: as they are, in wordings that no template has, and as parts of long texts."""

import re

import pytest

from veilmark.llm import licenses
from veilmark.llm.license_texts import TEXTS

WHOLE = dict(TEXTS)
HELD_OUT = {
    "mit": WHOLE["mit"].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM").replace("(the \"Software\")", "") + "Except as contained in this notice, the name of the X Consortium shall not be used in advertising.",
    "mit-0": "MIT No Attribution\n\nCopyright 2020 Someone\n" + WHOLE["mit-0"].replace("\n", " "),
    "bsd-2": WHOLE["bsd-2"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "AUTHOR OR").replace("1. ", "* ").replace("2. ", "* "),
    "bsd-3": WHOLE["bsd-3"].replace("the copyright holder nor the names of its", "Example Corp. nor the names of other").replace("COPYRIGHT HOLDERS", "REGENTS"),
    "isc": WHOLE["isc"].replace("and/or distribute", "and distribute").replace("THE AUTHOR", "ISC"),
    "0bsd": WHOLE["0bsd"].replace("and/or distribute", "and distribute"),
    "zlib": WHOLE["zlib"].replace("acknowledgment", "acknowledgement").replace("This notice may not be removed", "This notice must not be removed"),
    "unlicense": WHOLE["unlicense"] + "For more information, please refer to <https://unlicense.org>",
    "apache-2": re.sub("http\\S+ ", "https://apache.org/licenses/2 ", WHOLE["apache-2"]).replace("this file", "these files"),
    "gpl-2": WHOLE["gpl-2"].replace("This program", "Foo").replace("free software:", "free software;"),
    "gpl-3": WHOLE["gpl-3"].replace("This program", "Foo").replace("or (at your option) any later version", "only"),
    "lgpl-2": WHOLE["lgpl-2"] + "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Boston, USA",
    "lgpl-3": WHOLE["lgpl-3"].replace("library", "module"),
    "agpl-3": WHOLE["agpl-3"].replace("This program is", "Foo is"),
    "mpl-2": WHOLE["mpl-2"].replace("http://", "https://"),
}


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in licenses.op1_license_scan(rows).orderBy("doc_id").collect()]


def own(label, labels):
    """The labels without those of phrases, which no other license may take away."""
    return {x for x in labels.split(",") if x and not (x == "apache-2" and label != x)}


def test_whole_texts_and_held_out_wordings(spark):
    names = list(WHOLE)
    texts = [WHOLE[n] for n in names] + [HELD_OUT[n] for n in names]
    got = found(spark, texts)
    assert [(n, own(n, g)) for n, g in zip(names * 2, got, strict=True)] == [(n, {n}) for n in names * 2]


def test_licenses_within_a_long_text(spark):
    filler = " ".join(f"w{i % 977}" for i in range(30_000))
    text = f"{filler} {WHOLE['bsd-3']} {filler} {WHOLE['mit']} {WHOLE['zlib']} {filler}"
    assert found(spark, [text, filler]) == ["bsd-3,mit,zlib", ""]


@pytest.mark.parametrize("share, labels", [(0.5, "bsd"), (0.95, "bsd-2")])
def test_part_of_a_text(spark, share, labels):
    """Half of a text is less than what counts; its opening remains."""
    words = WHOLE["bsd-2"].split()
    assert found(spark, [" ".join(words[: int(share * len(words))])]) == [labels]
