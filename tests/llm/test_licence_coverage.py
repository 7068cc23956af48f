import pathlib

import pytest

from pulsegrid.llm import licences

SYSTEM = pathlib.Path("/usr/share/common-licenses")


def test_whole_texts_and_spdx_lines_outside_the_given_tables(spark):
    cases = [("AGPL-3.0", "# SPDX-License-Identifier: AGPL-3.0-or-later"), ("EPL-2.0", "// SPDX-License-Identifier: EPL-2.0"),
             ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0+")]
    docs = spark.createDataFrame([(i, f"prose\n{t}\nprose") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert {i: (r.license, r.n_lines, r.whole) for i, r in got.items()} == {i: (n, 1, False) for i, (n, _) in enumerate(cases)}


@pytest.mark.skipif(not SYSTEM.is_dir(), reason="no licence texts on this machine")
def test_full_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    texts = [(i, (SYSTEM / f).read_text().replace("\f", "").upper()) for i, f in enumerate(names)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scan(docs, licences.known_licences(spark)).where("whole").collect()}
    assert got == dict(enumerate(names.values()))
