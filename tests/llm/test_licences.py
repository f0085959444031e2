import random
from collections import defaultdict

import pytest

from ladderworks.llm.license_scan import LINES, NOTICES, PHRASES, Scanner, scan_licenses, template_words
from ladderworks.llm.words import ALNUM, split_words

SCHEMA = "doc_id bigint, text string, spans string, _row string"


def plain_matches(template, words, least):
    """Longest runs that end at each word and stand in the template, by trying all; those that can't be extended."""
    runs = []
    for k in range(1, len(words) + 1):
        best = (0, ())
        for n in range(1, min(k, len(template)) + 1):
            ends = tuple(e for e in range(n, len(template) + 1) if template[e - n : e] == words[k - n : k])
            if ends:
                best = (n, ends)
        runs.append(best)
    return [(k + 1, n, ends) for k, (n, ends) in enumerate(runs) if n >= least and (k + 1 == len(runs) or runs[k + 1][0] <= n)]


def test_matching_statistics_against_plain_search():
    r = random.Random(4)
    templates = {"a": ["a b c a b d", "b c"], "b": "c a b c a b c a", "c": ["d d d d d", "a b"], "long": " ".join(r.choice("abcd") for _ in range(30))}
    scanner = Scanner({"a b c": "x", "d": "y"}, templates)
    for _ in range(60):
        words = [r.choice("abcde") for _ in range(r.randint(0, 40))]
        ids = {w: i for s, t in zip(scanner.sequences, [*map(template_words, ["a b c", "d", "a b c a b d", "b c", "c a b c a b c a"])], strict=False) for i, w in zip(s, t, strict=True)}
        got, at = defaultdict(list), 0
        for run in " ".join(words).split("e"):
            run = run.split()
            for which, found in scanner.scan([ids[w] for w in run], at)[1].items():
                got[which] += found
            at += len(run) + 1
        for which in range(scanner.n_phrases, len(scanner.sequences)):
            template = [next(w for w, i in ids.items() if i == x) for x in scanner.sequences[which]]
            assert got[which] == plain_matches(template, words, scanner.least[which])


LINE_OF = {
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "Released under the MIT License.": {"mit"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"},
    "cc-by-nc-sa": {"cc-by", "cc-by-nc", "cc-by-nc-sa"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "under the GNU general public license, version 2": {"gpl", "gpl-2.0"},
    "// SPDX-License-Identifier: MIT": {"mit"},
    "# SPDX-License-Identifier: BSD-3-Clause": {"bsd"},
    "mit und ohne license, version 2.0 of it; the apache": set(),
    "All rights reserved": {"reserved"},
    "general public": set(),
    "": set(),
    None: set(),
}


def test_lines_and_notices(spark):
    r = random.Random(2)
    half = lambda k: " ".join(NOTICES[k].split()[: len(NOTICES[k].split()) // 2])
    rows = list(LINE_OF.items()) + [(f"x {NOTICES[k]} y", None) for k in NOTICES] + [(half(k), None) for k in NOTICES]
    data = spark.createDataFrame([(i, t, "s", "r") for i, (t, _) in enumerate(rows)] * 2, SCHEMA)
    got = defaultdict(list)
    for x in scan_licenses(data).collect():
        got[x.doc_id].append(({p["label"] for p in [*x.phrases, *x.spans]}, x.spans))
        assert x["_row"] == "r" and all(0 < s.share <= 1 and 0 <= s.first < s.past <= x.n_words for s in x.spans)
    for i, (text, want) in enumerate(rows):
        assert len(got[i]) == 2 and got[i][0] == got[i][1]
        if want is not None:
            assert got[i][0][0] == want, text
    for k, name in enumerate(NOTICES):
        whole, part = got[len(LINE_OF) + k][0], got[len(LINE_OF) + len(NOTICES) + k][0]
        assert name in whole[0] and name in part[0]
        assert max(s.share for s in whole[1] if s.label == name) == 1.0
    assert scan_licenses(data.limit(0)).collect() == [] and r


def test_a_template_that_repeats_itself_is_chained_at_its_second_place():
    text = "one two three four five six seven one two three four eight nine ten eleven twelve thirteen"
    scanner = Scanner({}, {"t": text})
    found = list(scanner.texts(split_words([("zero " + text.split(" ", 7)[7] + " z").encode()], ALNUM, lower=True)))
    assert [(s[0], s[1], s[2]) for s in found[0][2]] == [(1, 11, "t")] and found[0][2][0][3] == pytest.approx(10 / 17)


def test_long_texts_of_matches_are_linear():
    import time

    scanner = Scanner(PHRASES, {k: [v, *LINES.get(k, ())] for k, v in NOTICES.items()})
    text = (" ".join(NOTICES.values()) + " the license of the software ") * 300
    began = time.process_time()
    (n, places, spans), = scanner.texts(split_words([text.encode()], ALNUM, lower=True))
    assert sum(s[2] == "mit" for s in spans) >= 300 and time.process_time() - began < 20
