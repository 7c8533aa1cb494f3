from evidra.llm import license_scan


def scan(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in rows}


def test_notices(spark):
    got = scan(spark, [
        "Some text.\nLicensed under the Apache License, Version 2.0.",
        "x RELEASED under the  MIT license!",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "You may obtain a copy of the License at. You may not use this file except in compliance with the License.",
        "Licensed under CC BY-NC 4.0.",
        "A licence is a license of licenses.", None, "", "All rights reserved. Released under the MIT License. All rights reserved.",
    ])
    assert got[0] == (1, "1", "apache-2.0")
    assert got[1] == (0, "", "")  # one sentence, but not a known one
    assert got[2] == (3, "11,12,13", "gpl-3.0")
    assert got[3] == (2, "4,3", "")  # in the wrong order
    assert got[4] == (1, "15", "cc-by-nc-4.0")
    assert got[5] == got[6] == got[7] == (0, "", "")
    assert got[8] == (3, "21,5,21", "mit,proprietary")


def test_every_known_sentence_is_found(spark):
    got = scan(spark, [f"before\n{s}\nafter" for s in license_scan.SENTENCES.values()])
    assert [got[i][1] for i in range(len(got))] == [str(k) for k in license_scan.SENTENCES]


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
GPL = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{} either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_published_notices_as_wrapped(spark):
    got = scan(spark, [MIT, BSD, MPL, GPL.format(":", ",", 3), GPL.format(";", ";", 2), APACHE, MIT.replace("\n", "\r\n"), MIT.replace("\n\n", "\x00").replace("\n", " ").replace("\x00", "\n")])
    assert [got[i] for i in range(8)] == [
        (3, "7,8,9", "mit"), (3, "19,26,20", "bsd-3-clause"), (1, "22", "mpl-2.0"), (3, "11,12,13", "gpl-3.0"), (3, "11,12,14", "gpl-2.0"),
        (3, "2,3,4", "apache-2.0"), (3, "7,8,9", "mit"), (3, "7,8,9", "mit"),
    ]


def test_what_is_no_wrap(spark):
    got = scan(spark, ["Released under\n\nthe MIT License", "Released under\n * \n the MIT License", "Released under. The MIT License", "is Released under\nthe MIT License", "Released under\nthe MIT License or so", "Released under\nthe MIT License"])
    assert [got[i][2] for i in range(6)] == ["", "", "", "", "", "mit"]


BSD_2 = """Copyright (c) 2020, Someone
Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"""
CLAUSE_3 = """ * Neither the name of Example Org., Inc nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
LESSER = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
AFFERO = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_longer_notices_consume_their_sentences(spark):
    name = CLAUSE_3.replace("Org., Inc", "Org")
    got = scan(spark, [BSD_2.format(""), BSD_2.format(name), "// " + BSD_2.format(name).replace("\n", "\n// "), ISC, LESSER, AFFERO, BSD_2.format("") + "\n" + MIT,
                       "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "Apache License\nVersion 2.0, January 2004", "Released under the MIT License.\nReleased under the MIT License."])
    assert [got[i][2] for i in range(10)] == ["bsd-2-clause", "bsd-3-clause", "bsd-3-clause", "isc", "lgpl-2.1", "agpl-3.0", "bsd-2-clause,mit", "gpl-3.0", "apache-2.0", "mit"]
    assert got[9][1] == "5,5"


def test_unknown_licences(spark):
    got = scan(spark, ["This file is licensed under the Foo Bar License 7.", "You may use it under\n the terms of our agreement.", "Licensed under the Foo License.\nReleased under the MIT License.", "No word of it."])
    assert [got[i][2] for i in range(4)] == ["unknown", "unknown", "mit", ""]


def test_repeated_long_and_clashing(spark):
    long = "word " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 300_000
    rows = [(1, long, "a"), (1, long, "a"), (None, "Licensed under CC BY 4.0.", None), (2, None, "b")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("names", license_scan.F.lit(1))).collect()
    assert sorted((r["doc_id"] or 0, r["licenses"]) for r in got) == [(0, "cc-by-4.0"), (1, "mit"), (1, "mit"), (2, "")]


def test_odd_tables(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string, licenses int")).count() == 0
    plan = license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Exchange"))
