"""Licence scans against a plain version without any bound, and the recall of planted notices and licences."""

import math
import random
from collections import Counter

from tideglass.llm import licences as lic, queries as q


def plain(rows):
    """own licence and headers, and the licence of the whole text, from every cosine."""
    n = len(rows)
    df = Counter(w for _, text in rows for w in set(lic.words_of(text or "")))
    weight = lambda w: math.log((1 + n) / (1 + max(df[w], lic.RARE * n))) + 1

    def vector(words):
        v = {w: c * weight(w) for w, c in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    kinds = {"lesser", "affero", "documentation", "nc", "nd", "sa"}
    may = {(name, text): lic.marks(lic.words_of(text)) for name, text in lic.TEMPLATES}
    notices = [(name, *vector(lic.words_of(text)), may[name, text]) for name, text in lic.TEMPLATES]
    whole = [*notices, *((name, *vector(lic.words_of(text)), None) for name, text in lic.TEXTS)]

    def best(words, templates, header, named):
        v, norm = vector(words)
        if not norm:
            return 0.0, ""
        have = lic.marks(words)
        scores = [(round(sum(x * unit.get(w, 0) for w, x in v.items()) / norm / size, 6), name, want) for name, unit, size, want in templates if want is None or (want <= have and not (have - want) & kinds)]
        scores = [(score, name) for score, name, want in scores if score >= (named if want else header)]
        return min(scores, key=lambda s: (-s[0], s[1]), default=(0.0, ""))

    out = {}
    for d, text in rows:
        lines = [lic.words_of(x) for x in (text or "").split("\n")]
        runs = []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                words = [w for x in lines[i : j + 1] for w in x]
                if not lines[j] or (j > i and len(words) > 2 * lic.LONGEST):
                    break
                score, name = best(words, notices, lic.HEADER, lic.NAMED)
                if name and not all(lic.NOTICE_WORDS.isdisjoint(x) for x in lines[i : j + 1]):
                    runs.append((-score, j - i, i, j, name))
        found, taken = {}, set()
        for minus, _, i, j, name in sorted(runs):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                found[name] = max(-minus, found.get(name, 0))
        file = best([w for x in lines for w in x], whole, lic.FILE, lic.FILE)
        out[d] = (sorted(found), bool(file[1]))
    return out


def test_equals_all_cosines(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.headers, r.licence_file) for r in q.op6_licence_scan(spark, small_dir).collect()}
    want = plain(docs)
    assert got == want and sum(bool(h) for h, _ in want.values()) >= 3


def test_planted_notices_are_found(spark, sf_dir):
    """In documents of their own prose: notices as they are, wrapped at several widths with comment marks, and whole licences with a holder's line."""
    rng = random.Random(5)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    clean = [(d, t) for d, t in docs if not any(w in t for w in ("License", "Licensed"))]
    planted, rows = {}, []
    for i, (d, text) in enumerate(rng.sample(clean, 300)):
        name, notice = lic.TEMPLATES[i % len(lic.TEMPLATES)]
        words, lines, width = notice.split(), [], rng.choice((4, 7, 10, 1000))
        for a in range(0, len(words), width):
            lines.append(rng.choice(("# ", "// ", " * ", "")) + " ".join(words[a : a + width]))
        at = text.find("\n") + 1
        planted[10**6 + i] = name
        rows.append((10**6 + i, f"p{i}/a.txt", f"{text[:at]}\n" + "\n".join(lines) + f"\n\n{text[at:]}"))
    files = {}
    for i, (name, text) in enumerate(lic.TEXTS):
        files[2 * 10**6 + i] = name
        rows.append((2 * 10**6 + i, f"f{i}/LICENSE", f"Copyright (c) 20{i:02d} The People of Place {i}\n\n{text}"))
        rows.append((3 * 10**6 + i, f"f{i}/src/b.txt", clean[i][1]))
    rows += [(d, f"c{d}/x.txt", t) for d, t in docs]
    got = {r.doc_id: r for r in lic.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(8)).collect()}
    assert sum(name in got[d].headers for d, name in planted.items()) / len(planted) > 0.95
    assert all(got[d].licence_file and got[d + 10**6].licence == name for d, name in files.items())
    assert sum(got[d].licence is not None for d, _ in clean) <= 0.01 * len(clean)


# Headers as they are met, with the licence that they name; None where it is none that the library knows.
MET = (
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."),
    ("GPL-2.0", "This file is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "# SPDX-License-Identifier: MIT"),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in the\nSoftware without restriction, including without limitation the rights to use, copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "This article is licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-NC-ND-2.5", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 2.5 License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (None, "Licensed under the Apache License, Version 1.1."),
    (None, "This work is licensed under the GNU Free Documentation License, version 1.3."),
    (None, "This program is free software under the Eclipse Public License, version 2.0."),
    (None, "This work is licensed under the European Union Public License, version 3."),
    (None, "Licensed under CC BY 9.0."),
    (None, "This work is licensed under the GNU General Public License, version 4."),
    (None, "Released under the WTF License."),
)
# A second set, written after the notices were last changed.
MET_LATER = (
    ("GPL-3.0", "This package is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License; either version 3 of the License, or\nany later version."),
    ("GPL-2.0", "Distributed under the GNU General Public License version 2."),
    ("GPL-3.0", "This work is licensed under the terms of the GNU GPL, version 3."),
    ("LGPL-2.1", "Licensed under the LGPLv2.1 or later."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License v3.0."),
    ("AGPL-3.0", "/* SPDX-License-Identifier: AGPL-3.0-or-later */"),
    ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Distributed under the BSD 3-Clause License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("ISC", "Licensed under the ISC license."),
    ("Apache-2.0", "This software is licensed under the Apache License, version 2.0."),
    ("Apache-2.0", "The ASF licenses this file to You under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in compliance with\nthe License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-SA-3.0", "This work is licensed under CC BY-SA 3.0."),
    ("CC-BY-NC-2.0", "Licensed under a Creative Commons Attribution-NonCommercial 2.0 Generic License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the people of the place have waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (None, "Licensed under the Academic Free License, version 3.0."),
    (None, "Licensed under the Boost Software License, Version 1.0."),
    (None, "Licensed under the Open Software License, version 2.0."),
    (None, "Licensed under CC BY-NC 5.0."),
    (None, "This work is licensed under the GNU Affero General Public License, version 2."),
    (None, "SPDX-License-Identifier: EPL-2.0"),
)
# A third set, written after the rule and the notices were last changed.
MET_LAST = (
    ("GPL-2.0", "You may use, copy and change this file under the GNU General Public License, version 2 or later."),
    ("GPL-3.0", "License: GPLv3"),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("LGPL-3.0", "This library is distributed under the terms of the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This server is licensed under the AGPLv3."),
    ("Apache-2.0", "Available under the Apache License 2.0."),
    ("Apache-2.0", "Code in this folder is released under the Apache License, Version 2.0."),
    ("MIT", "This code is made available under the MIT license."),
    ("MIT", "MIT License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Text is available under CC BY 4.0."),
    ("CC-BY-SA-3.0", "Text is available under the Creative Commons Attribution-ShareAlike 3.0 License."),
    ("CC-BY-NC-4.0", "Photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    (None, "Licensed under the Common Development and Distribution License, version 1.0."),
    (None, "Released under the Artistic License, version 2.0."),
    (None, "The talk was given at MIT in 2019, and the license plate of the car was found later."),
    (None, "Licensed under the Mozilla Public License, version 3.0."),
    (None, "Gnu herds of two or three hundred animals cross the general area in public view."),
)


def test_headers_as_they_are_met_get_their_own_licence_or_none(spark, sf_dir):
    """Within documents of sf0.01, by the weights of all of its words."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    rows = [(d, f"c{d}/x.txt", x) for d, x in docs]
    prose = [x for _, x in docs if "License" not in x and "Licensed" not in x]
    met = MET + MET_LATER + MET_LAST
    for i, (_, header) in enumerate(met):
        rows.append((10**6 + i, f"p{i}/a.txt", f"{header}\n\n{prose[i]}"))
        rows.append((2 * 10**6 + i, f"q{i}/a.txt", header))
    got = {r.doc_id: r.licence for r in lic.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(8)).collect()}
    wrong = [(name, got[k * 10**6 + i], header) for i, (name, header) in enumerate(met) for k in (1, 2) if got[k * 10**6 + i] not in (name, None)]
    assert not wrong, wrong
    # Notices were added after MET was read, and the rule for names after MET_LATER was (it had 11 of 19 before); only MET_LAST is unseen. Floors are what was reached, not an aim.
    for n, some, least in ((0, MET, 23), (len(MET), MET_LATER, 17), (len(MET) + len(MET_LATER), MET_LAST, 11)):
        missed = [(name, header) for i, (name, header) in enumerate(some) if name and got[10**6 + n + i] is None]
        assert sum(name is not None for name, _ in some) - len(missed) >= least, missed
