"""Licence scans beside a plain Python form of the same cosines, and texts that differ in a version, a clause or a word."""

import math
import random
import re
from collections import Counter

from talus.llm import licenses

from .helpers import prose

TEXT = {name: [t for x, t in licenses.BLOCK_TEMPLATES if x == name] for name, _ in licenses.BLOCK_TEMPLATES}


def words(text):
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def pieces(text):
    """(is a block, words) of the sentences and blocks with a cue and without a denial."""
    lines = [re.sub(r"[ \t\r]*(?:\*+/|-->)?[ \t\r]*$", "", re.sub(r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)", "", x)).strip(" ") for x in text.split("\n")]
    head = []
    for raw, line in zip(text.split("\n"), lines, strict=True):
        if not re.match(r"[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)|\s*$", raw):
            break
        head.append(line)
    else:
        head = []
    found = [(False, x) for x in re.split(r"\n|(?<=[.;!?])\s+", text)] + [(True, x) for x in [*re.split(r"\n\n+", "\n".join(lines)), " ".join(head), " ".join(lines)]]
    for block, x in found:
        low = re.sub(r"\s+", " ", x).lower() if block else x.lower()
        if any(c in low for c in licenses.CUES) and not re.search(licenses.DENIAL, low):
            yield block, Counter(words(x))


def brute_force(texts):
    """{file: (licence, all licences)} by dense loops over notices and templates."""
    out, of_file = {}, {i: list(pieces(t)) for i, t in texts.items()}
    every = [p for ps in of_file.values() for p in ps]
    n = Counter(block for block, _ in every)
    df = Counter((block, w) for block, p in every for w in p)
    weigh = lambda block, c: {w: k * (math.log((n[block] + 1) / (df[block, w] + 1)) + 1) for w, k in c.items()}
    known = [(block, x, Counter(words(t)), licenses.needs(t), licenses.bars(x)) for block, table in ((False, licenses.TEMPLATES), (True, licenses.BLOCK_TEMPLATES)) for x, t in table]
    for i, ps in of_file.items():
        best = []
        for block, p in ps:
            w, mine = weigh(block, p), []
            for at, (kind, x, t, needs, bars) in enumerate(known):
                if kind != block or not set(needs) <= set(p) or set(bars) & set(p):
                    continue
                v = weigh(block, t)
                norm = math.sqrt(sum(a * a for a in w.values())) * math.sqrt(sum(a * a for a in v.values()))
                cosine = round(sum(w[k] * v[k] for k in w.keys() & v.keys()) / norm, 6) if norm else 0
                if cosine >= licenses.THRESHOLD:
                    sure = {"All-Rights-Reserved": 1, "BSD": 2}.get(x, 3)
                    mine.append((sure, sum((p & t).values()), cosine, -at, x))
            best += [max(mine)] if mine else []
        if best:
            sure = sorted({b[4] for b in best if b[0] == 3})
            out[i] = (max(best)[4], sure or [max(best)[4]])
    return out


def scanned(spark, texts):
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in texts.items()], "file_id long, path string, text string")
    return {r.file_id: (r.license, r.licenses) for r in licenses.scan(files).collect() if r.license}


def test_sentences_and_blocks_as_dense_loops_find_them(spark):
    """Templates whole, wrapped, commented, joined with others, cut short and mixed with prose."""
    r, texts = random.Random(5), {}
    for x, t in licenses.TEMPLATES + licenses.BLOCK_TEMPLATES:
        ws = t.split(" ")
        wrapped = " ".join(w + ("\n" if k % 9 == 8 else "") for k, w in enumerate(ws)).replace("\n ", "\n")
        cut = " ".join(w for w in ws if r.random() < 0.85)
        other = r.choice(licenses.TEMPLATES)[1]
        forms = [t, "/*\n * " + wrapped.replace("\n", "\n * ") + "\n */\nint x;", "# " + wrapped.replace("\n", "\n# ") + "\n\nx = 1\n\n# " + other, cut, f"{prose(r.randrange(99), 30)}. {t} {other}", f"{prose(r.randrange(99), 9)}\n\n{wrapped}\n\n{other}"]
        for form in forms:
            texts[len(texts)] = form
    expected = brute_force(texts)
    assert scanned(spark, texts) == expected and len(expected) > 200 and any(len(found) > 1 for _, found in expected.values())


def test_versions_clauses_and_denials(spark):
    """A differing version, clause, family or a denial is no match; of several matches the one that explains most words counts."""
    bsd2, bsd3 = TEXT["BSD-2-Clause"][0], TEXT["BSD-3-Clause"][0]
    cases = [
        (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (bsd2.replace(", ", ",\n"), "BSD-2-Clause"), (dict(licenses.TEMPLATES)["BSD"], "BSD"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Licensed under the Apache License, Version 3.0.", None), ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU General Public License, version 2.0.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 7.", None), ("Licensed under CC BY 3.0.", None),
        ("This is not licensed under the Apache License, Version 2.0.", None), ("This isn't licensed under the MIT License.", None), ("Released under the XYZ License.", None), ("All rights reserved.\nReleased under the MIT License.", "MIT"),
        (TEXT["BSL-1.0"][0], "BSL-1.0"), (TEXT["MIT"][-1], "MIT"), ("", None), (None, None),
    ]
    got = scanned(spark, {i: t for i, (t, _) in enumerate(cases)})
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (_, x) in enumerate(cases) if x}


def test_tags_are_read_as_they_stand(spark):
    texts = {
        1: "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", 2: "# spdx-license-identifier: (AGPL-3.0-only AND LGPL-2.1-only) WITH Classpath-exception-2.0", 3: "/* SPDX-License-Identifier: GPL-2.0+ */",
        4: "<!-- SPDX-License-Identifier: BSD-2-Clause. -->\nReleased under the MIT License.", 5: "; SPDX-License-Identifier: MIT\n; SPDX-License-Identifier: ISC", 6: "SPDX-License-Identifier:", 7: "SPDX-License-Identifier: MIT or so they say",
    }
    assert scanned(spark, texts) == {
        1: ("MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), 2: ("(AGPL-3.0-only AND LGPL-2.1-only) WITH Classpath-exception-2.0", ["AGPL-3.0-only", "LGPL-2.1-only"]), 3: ("GPL-2.0+", ["GPL-2.0+"]),
        4: ("BSD-2-Clause", ["BSD-2-Clause"]), 5: ("MIT", ["ISC", "MIT"]), 7: ("MIT", ["MIT"]),
    }


def test_every_licence_beside_a_directory_is_inherited(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License.\nLicensed under CC BY 4.0."), (2, "a/b/x.py", "x = 1"), (3, "a/b/LICENSE", "All rights reserved."), (4, "c.py", None), (None, "a/y.py", "x")]
    got = {r.file_id: (r.license, r.licenses, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", ["CC-BY-4.0", "MIT"], "a"), 2: ("All-Rights-Reserved", ["All-Rights-Reserved"], "a/b"), 3: ("All-Rights-Reserved", ["All-Rights-Reserved"], "a/b"), 4: (None, None, None),
    }
