from slicewise.llm import license as L


def test_rules_follow_the_order_of_sentences(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
           "Redistributions of source code must retain the notice.\nRedistributions in binary form must reproduce it.\n")
    texts = {
        1: "Intro.\n// Licensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at x.", 2: "Released under the MIT License.",
        3: "This work is licensed under the GNU General Public License, version 3. Later", 4: "Licensed under CC BY-NC 4.0.",
        5: bsd, 6: bsd + "Neither the name of X may be used to endorse products.", 7: "GNU General Public License version 2 or (at your option) any later version",
        8: "Some odd license of our own.", 9: None, 10: "", 11: "no such thing here. " * 5000 + "Released under the MIT License.",
        12: "Released under the MIT License. Also licensed under CC BY-SA.", 13: "Redistributions of source code must retain it. " + "Redistributions in binary form must reproduce"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(2, texts[2], "x")], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in L.digest(df).collect()}
    assert {i: r.licenses for i, r in got.items()} == {
        1: "Apache-2.0", 2: "MIT", 3: "GPL-3.0", 4: "CC-BY-NC", 5: "BSD-2-Clause", 6: "BSD-3-Clause", 7: "GPL-2.0-or-later", 8: "", 9: "", 10: "",
        11: "MIT", 12: "MIT,CC-BY-SA", 13: ""}
    assert (got[8].n_known, got[8].n_unknown, got[13].n_known) == (0, 1, 2)
    assert L.scan(df).count() == 14 and L.scan(df).columns == ["doc_id", "text", "license"]
    assert L.digest(df.limit(0)).collect() == []


GPL = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() { return 0; }
"""
BSD = """# Copyright (c) 2019, Some Body
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright
#    notice, this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright
#    notice, this list of conditions.
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products.
#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
# "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
WRAPPED = {
    1: (GPL, "GPL-2.0-or-later", "GPLRef2,GPLLater,GPLWarranty,?"),
    2: (GPL.replace("General Public", "Lesser\n * General Public").replace("version 2", "version 2.1"), "LGPL-2.1", None),
    3: (GPL.replace("General Public", "Affero General\n * Public").replace("version 2", "version 3"), "AGPL-3.0", None),
    4: (BSD, "BSD-3-Clause,proprietary", "Copyright,AllRights,BSDPermission,BSDSource,BSDBinary,BSDEndorse,BSDWarranty"),
    5: (BSD.replace("# 3. Neither the name of the copyright holder nor the names of its\n#    contributors may be used to endorse or promote products.\n", ""),
        "BSD-2-Clause,proprietary", None),
    6: (APACHE, "Apache-2.0", None), 7: (MIT, "MIT", "MITPermission,MITNotice,MITWarranty"),
    8: (GPL.replace("\n", "\r\n"), "GPL-2.0-or-later", "GPLRef2,GPLLater,GPLWarranty,?"),
    9: (GPL.replace("\n * ", " ").replace("\n *\n", "\n\n"), "GPL-2.0-or-later", None),
    10: ("This is free and unencumbered software released into\nthe public domain.", "Unlicense", None),
    11: ("Made available under the terms of the Eclipse\nPublic License v2.0", "EPL-2.0", None),
    12: ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, as said.", "ISC", None),
}


def test_wrapped_headers_and_their_sql(spark, tmp_path):
    import duckdb
    import pandas as pd

    from slicewise.llm import oracle
    texts = {i: t for i, (t, _, _) in WRAPPED.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in L.digest(df).collect()}
    for i, (_, names, ids) in WRAPPED.items():
        assert got[i].licenses == names, (i, got[i])
        assert ids is None or got[i].sentence_ids == ids
    documents = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})  # noqa: F841  (read by name)
    con = duckdb.connect()
    con.register("documents", documents)
    rows = con.execute(oracle.ORACLES["op5_license"]).fetchall()
    assert sorted(rows) == sorted((r.doc_id, r.n_known, r.n_unknown, r.sentence_ids, r.licenses) for r in got.values())
