import random

import pytest

from auditspark.llm import line_spread as L


def brute(rows, t):
    spread = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            x = x.strip(" \t\r")
            if x and site is not None:
                spread.setdefault(x, set()).add(site)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((-1 if i is None else i, None, 0, 0))
            continue
        a = text.split("\n")
        k = [x for x in a if len(spread.get(x.strip(" \t\r"), ())) < t]
        out.append((-1 if i is None else i, "\n".join(k), len(a), len(a) - len(k)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("t,sites", [(1, 3), (5, 8), (300, 900)])
def test_against_brute_force(spark, t, sites):
    r = random.Random(t)
    lines = ["line %d" % k for k in range(12)] + ["", " ", "\tline 3\r", "Line 3", "é ü"]
    rows = []
    for i in range(max(80, 2 * sites)):
        site = "s%d" % r.randrange(sites)
        text = [r.choice(lines[: 1 + r.randrange(len(lines))]) for _ in range(r.randint(0, 6))] + ["own %d" % r.randrange(50)]
        rows.append((i, "\n".join(text), site))
    rows += [(1, None, "s1"), (1, "", "s1"), (None, "line 0\nx", None), (2, "a\nline 0\n\n", "s2"), (2, "a\nline 0\n\n", "s2"),
             (3, "line 0\n" * 50000, "s1"), (4, "own null", None)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "doc_id long, text string, source string, line string").repartition(3)
    got = [(-1 if x.id is None else x.id, x.text, x.n_lines, x.n_removed) for x in L.remove_boilerplate(df, min_sites=t).collect()]
    assert sorted(got, key=repr) == brute(rows, t)


def test_empty(spark):
    assert L.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
