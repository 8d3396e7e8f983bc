"""Notices and whole license texts, with inserted words and licenses that differ by a name or number."""

from tracelens.llm.license_texts import license_texts, scan_license_texts

TEXTS = dict(license_texts())
MIT, GPL = TEXTS["mit"], " ".join(TEXTS["gpl-3"].split()[2000:2100])
DOCS = [
    (1, "© Somebody. All rights reserved."), (2, "All rights are reserved."), (3, "all the rights we had reserved"), (4, f"w x {MIT} y z"), (5, GPL),
    (6, "Licensed under a CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 3.0."), (8, "Licensed under the Apache License, Version 1.1."),
    (9, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), (10, None), (11, ""), (12, "This work is licensed under the GNU Affero General Public License, version 3."),
    (13, "So licensed under the well-known Apache License, Version 2.0."),
]


def test_notices_and_texts(spark):
    rows = scan_license_texts(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)).collect()
    got = {i: {r.license: r for r in rows if r.doc_id == i} for i, _ in DOCS}
    assert set(got[1]) == {"all-rights-reserved"} and got[1]["all-rights-reserved"].first_word == 1
    assert set(got[2]) == {"all-rights-reserved"} and not got[3] and not got[10] and not got[11]
    assert got[4]["mit"].first_word == 2 and got[4]["mit"].n_pairs == got[4]["mit"].of_pairs and set(got[4]) == {"mit"} and got[4]["mit"].n_templates >= 7
    assert "gpl-3" in got[5]
    assert set(got[6]) == {"cc-by-nc-4.0"} and not got[7] and not got[8]
    assert set(got[9]) == {"cc-by-sa-4.0"} and "gpl-3.0" not in got[12]
    assert set(got[13]) == {"apache-2.0"} and got[13]["apache-2.0"].first_word == 1
