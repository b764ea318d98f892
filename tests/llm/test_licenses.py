"""Licence scan against a loop, and on whole and damaged licence passages."""

import re
from collections import defaultdict

from lectern.llm import licenses
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = (
    "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
    'documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, '
    "merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so"
)
CASES = [
    (1, MIT), (2, MIT.replace("without restriction", "with restriction")), (3, "// Licensed under CC BY-NC 4.0."),
    (4, "Released under the MIT License. See the MIT license, or the Apache-License."), (5, "a general public licence; general public license"),
    (6, "This work is licensed under the GNU General Public License, version 3."), (7, MIT.replace("merge, ", "merge, fuse, ")),
    (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (9, "sublicense " * 300 + MIT), (9, "sublicense " * 300 + MIT), (10, "général public license mit  license mit\nlicense"), (11, "permission is hereby granted free of charge to deal"),
    (12, "MITlicense mit1 license"),
]


def brute(rows):
    postings, mass, out = defaultdict(list), defaultdict(int), []
    for word, t, at, weight in licenses.index():
        postings[word].append((t, at, weight))
        mass[t] += weight
    lower = str.maketrans(licenses.UPPER, licenses.LOWER)
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(lower))
        whole = f" {' '.join(words)} "
        starts = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        met = defaultdict(set)
        for i, w in enumerate(words):
            for t, at, weight in postings.get(w, ()):
                for phase in (0, licenses.SPREAD // 2):
                    met[t, phase, (i - at + phase) // licenses.SPREAD].add((at, weight))
        more = {}
        for (t, *_), got in met.items():
            share = sum(w for _, w in got) / mass[t]
            label, phrases, _ = licenses.TEMPLATES[t]
            if share >= licenses.LEAST and all(f" {p} " in whole for p in phrases):
                more[label] = max(share, more.get(label, 0))
        own = {label for _, label in starts}
        ends = (starts[0][0], starts[-1][0]) if starts else (None, None)
        score = 1.0 if own else round(max(more.values(), default=0.0), 9)
        out.append((doc_id, len(words), len(starts), *ends, ",".join(sorted(own)), ",".join(sorted(own | set(more))), score))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    return sorted(((*tuple(r)[:-1], round(r["score"], 9)) for r in rows), key=repr)


def test_equals_a_loop(spark):
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in CASES], "doc_id long, text string, w string, i int").repartition(4)
    found = got(licenses.scan(table))
    assert found == brute(CASES)
    labels = {r[0]: r[6] for r in found}
    assert labels[1] == labels[7] == labels[9] == "mit" and labels[2] == "" and labels[3] == "cc-by-nc" and labels[8] == "bsd" and labels[12] == ""
    assert labels[4] == "apache,mit" and labels[6] == "gpl" and labels[11] == ""


def test_edge_rows(spark):
    assert got(licenses.scan(edge.docs(spark))) == brute([(r[0], r[1]) for r in edge.ROWS])
    assert licenses.scan(edge.empty(spark)).collect() == []


def test_main_path_has_no_python(spark, capsys):
    licenses.scan(edge.docs(spark)).explain()
    assert "Python" not in capsys.readouterr().out
