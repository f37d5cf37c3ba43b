from __future__ import annotations

import re

from topoeval.llm import licenses as L


def grams(text):
    w = re.findall("[a-z0-9]+", text.translate(L.LOWER))
    return set(zip(w, w[1:], strict=False))


def by_hand(text):
    """Every unit against every template, without bounds."""
    n, found = 0, {}
    for unit in L.units(text or ""):
        hit = False
        for name, t in L.TEMPLATES:
            a, b = grams(unit), grams(t)
            d = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
            if d >= L.THRESHOLD:
                hit = True
                found[name] = max(found.get(name, 0), d)
        n += hit
    best = min(found, key=lambda k: (-found[k], k), default=None)
    return n, ",".join(sorted(found)), best, round(found.get(best, 0.0), 6)


TEXTS = [
    "abc\nLicensed under the Apache License, Version 2.0.\nxyz",
    "RELEASED under the mit LICENSE.",
    "This work is licensed under the GNU General Public License, version 3.\n\nReleased under the MIT License",
    "Licensed under CC BY-NC 4.0. And so on, and so on, and so on, far beyond the size of it.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\n(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,\npublish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:",
    "nothing of the kind",
    "License",
]


def test_by_hand(docs, odd, none):
    for df in (docs([*enumerate(TEXTS)]), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted((tuple(r) for r in L.license_scan(df).collect()), key=str)
        assert got == sorted(((i, *by_hand(t)) for i, t in rows), key=str)
    assert L.license_scan(none).count() == 0


def test_finds():
    s = L.Scanner()
    assert s.scan(TEXTS[0])[1:] == (["Apache-2.0"], "Apache-2.0", 1.0)
    assert s.scan(TEXTS[4])[1] == ["MIT"]
    assert s.scan(TEXTS[2])[0] == 3  # both lines, and the whole, which is near the first
    assert s.scan(TEXTS[3])[0] == s.scan(TEXTS[5])[0] == 0
