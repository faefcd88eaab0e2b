import re
import time

from pyspark.sql import functions as F

from cloakwork.llm import license_scan as N
from tests.llm.helpers import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = N.TEMPLATES["MIT"]
TEXTS = [None, "", "x", "hello\nReleased under the MIT license!\nbye", "Copyright 2020 Me\n" + MIT, "intro\n\n" + MIT.replace(". ", ".\n") + "\n\nend", "é " * 5000, "All rights reserved.", "by nc 4 0", "Licensed under CC BY-NC 4.0", "released under the " * 50]


def bigrams(t):
    w = WORD.findall(t.translate(LOWER))
    return set(zip(w, w[1:]))


def brute(text):
    text = text or ""
    paragraphs = re.split(N.PARAGRAPHS, text)
    segments = [(0, i, s) for i, s in enumerate(text.split("\n"))] + [(1, i, s) for i, s in enumerate(paragraphs) if "\n" in s] + ([(2, 0, text)] if len(paragraphs) > 1 else [])
    found = []
    for level, i, s in segments:
        own = bigrams(s)
        for name, t in N.TEMPLATES.items():
            other = bigrams(t)
            if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                found.append((-round(2 * len(own & other) / (len(own) + len(other)), 6), level, name, i))
    return sorted(found)


def test_against_brute_force(spark):
    docs = documents(spark, TEXTS, [(3, TEXTS[3]), (None, TEXTS[3])])
    got = N.scan(docs.withColumn("matches", F.lit(0))).collect()
    want = sorted((str(r.doc_id), brute(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), [(m.order, m.level, m.template, m.place) for m in r.matches]) for r in got) == want
    assert any(m for _, m in want)


def test_empty(spark):
    assert N.scan(documents(spark, TEXTS).limit(0)).count() == 0


def test_anchors_cover_every_template():
    needed = N.anchors(N.TEMPLATES, 80)
    for t in N.TEMPLATES.values():
        pairs = bigrams(t)
        free = [p for p in pairs if not any(c in w if len(c) > N.SHORT else c == w for c in needed for w in p)]
        assert len(free) < len(pairs) * 80 / 120


def brute_runs(text):
    """brute, and the best runs of lines apart from each other and from what brute has."""
    found, lines = brute(text), (text or "").split("\n")
    places, at = [], 0
    for part, gap in zip(re.split(N.PARAGRAPHS, text or ""), [*re.findall(N.PARAGRAPHS, text or ""), ""]):
        places.append((at, at + part.count("\n")))
        at += part.count("\n") + gap.count("\n")
    extra = []
    for name, t in N.TEMPLATES.items():
        other, taken, every = bigrams(t), [], []
        for _, level, n, i in found:
            if n == name:
                taken.append([(i, i), places[i] if level == 1 else None, (0, len(lines))][level])
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                own = bigrams("\n".join(lines[i : j + 1]))
                if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                    every.append((-round(2 * len(own & other) / (len(own) + len(other)), 6), j - i, i, j))
        for order, _, i, j in sorted(every):
            if not any(a <= j and i <= b for a, b in taken):
                taken.append((i, j))
                extra.append((order, 3, name, i))
    return sorted(found + extra)


def laid_out(name, *breaks):
    """A template with blank lines before the words given."""
    t = N.TEMPLATES[name]
    for b in breaks:
        assert b in t
        t = t.replace(b, "\n\n" + b)
    return t


PROSE = "\n\n".join(f"Chapter {i} of the work tells\nwhat the software of house {i} is for: n{i} a{i} b{i} c{i} d{i}." for i in range(20))
PARTED = {
    "MIT": laid_out("MIT", "The above copyright notice", "THE SOFTWARE IS PROVIDED"),
    "Apache-2.0-notice": laid_out("Apache-2.0-notice", "http://www", "Unless required"),
    "GPL-3.0-notice": laid_out("GPL-3.0-notice", "This program is distributed", "You should have"),
}


def test_licences_in_their_normal_layout(spark):
    texts = [f"{PROSE}\n\n{t}\n\n{PROSE}" for t in PARTED.values()]
    texts += ["int a;\n" + PARTED["MIT"].replace(", ", ",\n").replace("\n\n", "\n") + "\nint b;\n" * 9 + PROSE, PROSE + "\n\n" + "\n \n\t\n  ".join(PARTED.values()) + "\n\n" + PARTED["MIT"] + "\n" + PROSE]
    texts += [PROSE, "all\nrights\nreserved\nx y\nall rights\nreserved", "\n\n\nMIT\n" + PARTED["GPL-3.0-notice"].replace(" ", "\n", 60) + PROSE]
    docs = documents(spark, texts)
    got = {r.doc_id: [(m.order, m.level, m.template, m.place) for m in r.matches] for r in N.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_runs(t), t
    for i, name in enumerate(PARTED):
        assert [m[1:] for m in got[i] if m[2] == name] == [(3, name, PROSE.count("\n") + 2)]
    assert N.digest(N.scan(docs.limit(1))).first().matches == f"MIT:run:{PROSE.count(chr(10)) + 2}"


def test_many_licence_lines_in_one_text(spark):
    """The same line over and over, and runs of three lines with others between; times, and the whole result."""
    n = 16_000
    lines = "All rights reserved.\n" * n
    parted = "".join(f"all\nrights\nreserved\nword{i} of{i} page{i}\n" for i in range(n // 4))
    docs = documents(spark, [lines, parted])
    began = time.perf_counter()
    got = {r.doc_id: r for r in N.digest(N.scan(docs)).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].matches.split(",")[:n] == [f"Reserved-line:line:{i}" for i in range(n)]
    assert got[1].matches.split(",") == [f"Reserved-line:run:{4 * i}" for i in range(n // 4)]


def test_repeated_lines_against_brute_force(spark):
    """Texts in which the pairs not seen since a start are few and far."""
    rare = "".join("all rights\n" * 40 + f"reserved {'x' * i}\n" for i in range(1, 4))
    texts = [rare, "All rights reserved.\n" * 30 + "all\nrights\nreserved x\n" + "x\n" * 40 + "reserved", ("all rights\n" + "x all\n" * 30 + "reserved all rights\nreserved\n") * 3]
    docs = documents(spark, texts)
    got = {r.doc_id: [(m.order, m.level, m.template, m.place) for m in r.matches] for r in N.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_runs(t), t
