"""License notices inside a sentence or over a line end."""

from collections import Counter

from threadloom.llm import license_scan


def test_license_notice_inside_a_sentence(spark):
    t = license_scan.TEMPLATES
    rows = [
        (1, "This project is released under the MIT License."),
        (2, "Copyright 2020 X, licensed under the Apache License, Version 2.0"),
        (3, "The text is free: this work is licensed under the GNU General Public License, version 3, and the data is licensed under CC BY 4.0."),
        (4, "This work is\nlicensed under the GNU General Public License, version 2."),
        (5, "We know that it is licensed under the Apache License, Version 1.1, and that a licence to fish is not released under the MIT rules."),
        (6, "In short, " + t["MIT"].replace("hereby granted", "granted").replace("any person", "each person")),
        (7, t["MIT-notice"]),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter([(1, "MIT-notice"), (2, "Apache-2.0-notice"), (3, "GPL-3.0-notice"), (3, "CC-BY-4.0"), (4, "GPL-2.0-notice"), (6, "MIT"), (7, "MIT-notice")])
    blocks = {(r.doc_id, r.license): dict(rows)[r.doc_id][r.block_start : r.block_end] for r in got}
    assert blocks[1, "MIT-notice"] == "released under the MIT License" == blocks[7, "MIT-notice"].lower().replace("mit l", "MIT L")
    assert blocks[2, "Apache-2.0-notice"] == "licensed under the Apache License, Version 2.0"
