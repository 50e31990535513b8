"""License scans against the coefficient of every passage and every template."""

import random
import re

from panelwright.llm import licenses as lc

SCHEMA = "doc_id long, text string, line string, license int, dice string"


def brute(rows, least):
    words = lambda t: re.findall(lc.WORD_CLASS, "".join(c.lower() if c.isascii() else c for c in t))
    own = {n: lc.bigrams(words(t)) for n, t in lc.TEMPLATES.items()}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        for number, passage in [*enumerate(lines, 1), *([(0, "\n".join(lines))] if len(lines) > 1 else [])]:
            b = lc.bigrams(words(passage))
            scored = [(-2 * len(b & t) / (len(b) + len(t)), n) for n, t in own.items() if b and 2 * len(b & t) >= least * (len(b) + len(t))]
            if scored:
                out.append((doc_id, number, min(scored)[1], -min(scored)[0]))
    return sorted(out, key=repr)


def test_changed_templates_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(["the", "license", "under", "été", "software", "a"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(3))]
        words = rng.choice(list(lc.TEMPLATES.values())).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "X-Y"])
        lines.insert(rng.randrange(len(lines) + 1), rng.choice([" ", "  ", " * "]).join(words))
        rows.append((i, rng.choice(["\n", "\n"]).join(lines), "x", 1, "y"))
    rows += [(None, lc.TEMPLATES["isc"], None, None, None), (200, None, "x", 1, "y"), (201, "", "x", 1, "y"), (202, "license", "x", 1, "y"), rows[0], (203, "w " * 200000 + "\n" + lc.TEMPLATES["mit-note"], "x", 1, "y"),
             (204, lc.TEMPLATES["mit-grant"].replace(", ", ",\n"), "x", 1, "y")]
    got = lc.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 0.8)
    assert {r.license for r in got if r.doc_id == 204} == {"mit-grant"}


def test_empty_tables(spark):
    assert lc.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lc.scan_licenses(spark.createDataFrame([(1, "Released under the MIT License.", "x", 1, "y")], SCHEMA), {}).count() == 0


def brute_windows(words, templates, least):
    """Every window of every length against every template."""
    def apart(rows):
        out = []
        for row in sorted(rows):
            if all(row[-2] + row[-1] <= a or a + n <= row[-2] for *_, a, n in out):
                out.append(row)
        return out

    best = []
    for name, text in templates.items():
        own = lc.bigrams(re.findall(lc.WORD_CLASS, text.lower()))
        found = []
        for a in range(len(words)):
            for n in range(1, int(len(own) * (2 - least) / least + 1e-9) + 1):
                b = lc.bigrams(words[a:a + n + 1])
                if a + n < len(words) and 2 * len(b & own) >= least * (len(b) + len(own)):
                    found.append((-2 * len(b & own) / (len(b) + len(own)), n + 1, a, len(b & own), a, n + 1))
        best += [(-common, dice, name, a, n) for dice, n, a, common, *_ in apart(found)]
    return sorted([(-dice, name, a, a + n) for _, dice, name, a, n in apart(best)], key=lambda w: w[2])


def test_windows_against_all_windows():
    rng = random.Random(5)
    some = {n: lc.TEMPLATES[n] for n in ("mit-note", "all-rights-reserved", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-sa-long", "mit-notice", "isc")}
    known, hits = lc.Templates(some, 0.8), 0
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(["the", "license", "under", "software", "x", "all", "x"]) for _ in range(rng.randrange(6))]
            notice = re.findall(lc.WORD_CLASS, rng.choice(list(some.values())).lower())
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(["other", "the", "x"])
            words += notice
        want = brute_windows(words, some, 0.8)
        hits += len(want)
        assert known.windows(words) == want
    assert hits > 100


def test_notices_over_several_lines_and_within_lines(spark, tmp_path):
    import textwrap

    from panelwright.llm.queries import QUERIES

    code, rows, want = "\n".join(f"int f{i}(int a) {{ return a + {i}; }}" for i in range(80)), [], set()
    for i, (name, text) in enumerate(sorted(lc.TEMPLATES.items())):
        wrapped = textwrap.wrap(text, 70)
        rows.append((i, "/*\n" + "\n".join(" * " + line for line in wrapped) + "\n */\n" + code, "x", 1, "y"))
        rows.append((100 + i, f"Some words come first, in {i} lines. {text} More words follow it, as they do.\n{code}", "x", 1, "y"))
        want |= {(i, 2, 1 + len(wrapped), name), (100 + i, 1, 1, name)}
    rows += [(300, None, "x", 1, "y"), (301, "", "x", 1, "y"), (None, f"{lc.TEMPLATES['mit-note']} {lc.TEMPLATES['mit-note']}\nand {lc.TEMPLATES['isc']}", "x", 1, "y")]
    want |= {(None, 1, 1, "mit-note"), (None, 2, 2, "isc")}
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_license_notices"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.first_line, r.last_line, r.license) for r in got} == want and len(got) == len(want) + 1
    assert all(r.dice == 1 for r in got)
    assert lc.scan_notices(spark.createDataFrame([], SCHEMA)).count() == 0 and lc.scan_notices(spark.createDataFrame(rows, SCHEMA), {}).count() == 0
