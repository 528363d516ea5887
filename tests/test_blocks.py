"""Text of blocks from spans, against a plain version that follows the rules one block at a time."""

from __future__ import annotations

import random
import re
from collections import Counter

from quillstack.operators import blocks

SCHEMA = "block int, left double, line int, lx0 double, ly0 double, lx1 double, ly1 double, x0 double, y0 double, x1 double, y1 double, text string, font string, size double"
ROLES = {"Courier": "code", "CMMI10": "math", "Times-Bold": None, "Times": None}


def made(seed, n=40):
    r = random.Random(seed)
    out = []
    for b in range(n):
        y, left = 0.0, 10.0
        for line in range(r.randint(1, 6)):
            y += r.choice((0.0, 0.5, 14.0, 14.0, 14.0, 22.0))
            lx0 = left + r.choice((0.0, 0.0, 7.0, 40.0))
            x, code = lx0, r.random() < 0.4
            spans = []
            for _ in range(r.randint(1, 4)):
                text = r.choice(("ab", "c. ", "end.", "Note", " ", "", "  x", "第。", "Problem 1", "tab\t", "q?)"))
                width = 3.0 * len(text) + 0.5
                spans.append((x, y, x + width, y + 12, text, "Courier" if code and r.random() < 0.9 else r.choice(tuple(ROLES)), r.choice((9.0, 10.0, 12.0))))
                x += width + r.choice((0.0, 0.9, 1.2, 1.5, 5.0)) + 0.01
            out += [(b, left, line, lx0, y, x, y + 12, *s) for s in spans]
    return out


def plain(spans):
    """text, lines, paragraphs, fonts and runs of one block."""
    kept = []
    for line in sorted({s[2:7] for s in spans}, key=lambda l: (l[2], l[1], l[0])):
        for row in kept:
            if abs(row["y0"] - line[2]) <= 1.2 and abs(row["y1"] - line[4]) <= 1.2:
                break
        else:
            row = {"y0": line[2], "y1": line[4], "x0": line[1], "ids": []}
            kept.append(row)
        row["y0"], row["y1"], row["x0"] = min(row["y0"], line[2]), max(row["y1"], line[4]), min(row["x0"], line[1])
        row["ids"].append(line[0])
    done, fonts = [], Counter()
    for row in sorted(kept, key=lambda r: (r["y0"], r["x0"])):
        mine = sorted((s for s in spans if s[2] in row["ids"] and s[11]), key=lambda s: (s[7], s[8], s[2], s[9], s[11]))
        if not mine:
            continue
        code = sum(len(s[11]) for s in mine if ROLES[s[12]] == "code") / sum(len(s[11]) for s in mine)
        middle = sorted(s[13] for s in mine)[len(mine) // 2]
        text = " " * max(0, round((row["x0"] - spans[0][1]) / max(1.0, middle * 0.52))) if code >= 0.7 else ""
        runs = []
        for k, s in enumerate(mine):
            if k and mine[k - 1][11][-1] not in " \t" and s[7] - mine[k - 1][9] > max(1.0, s[13] * 0.14):
                text += " "
            if ROLES[s[12]]:
                runs.append((len(text), len(text) + len(s[11]), ROLES[s[12]]))
            text += s[11]
            fonts[s[12]] += len(s[11])
        done.append((row["y0"], row["y1"], text.rstrip(), runs))
    gaps = sorted(b[0] - a[1] for a, b in zip(done, done[1:]) if b[0] >= a[1])
    middle = gaps[len(gaps) // 2] if gaps else 0.0
    whole, paragraphs, found = "", 1, []
    for k, (y0, _, text, runs) in enumerate(done):
        if k:
            closed = re.search(r"[.!?。！？][\"')\]]?$", done[k - 1][2].rstrip())
            new = closed and (y0 - done[k - 1][1] > middle + 0.2 or re.match(r"(?:Problem|Deliverable|For reference|Note)\b", text.lstrip()))
            whole += "\n\n" if new else "\n"
            paragraphs += bool(new)
        found += [(len(whole) + a, min(len(whole) + b, len(whole) + len(text)), role) for a, b, role in runs]
        whole += text
    cut, text = len(whole) - len(whole.lstrip()), whole.strip()
    ranges = [(max(a, cut) - cut, min(b, cut + len(text)) - cut, role) for a, b, role in found]
    return (text, len(done), paragraphs, [f for f, _ in fonts.most_common()]) if done else None, sorted((a, b, text[a:b], role) for a, b, role in ranges if a < b)


def test_block_texts(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {b: plain([r for r in rows if r[0] == b]) for b in {r[0] for r in rows}}
    got = {r.block: r for r in blocks.block_texts(df).collect()}
    assert {b: (r.text, r.lines, r.paragraphs, [f.font for f in r.fonts]) for b, r in got.items()} == {b: w[0] for b, w in want.items() if w[0]}
    runs = {}
    for r in blocks.protected_runs(df).collect():
        runs.setdefault(r.block, []).append((r.start, r.end, r.text, r.role))
    assert {b: sorted(v) for b, v in runs.items()} == {b: w[1] for b, w in want.items() if w[1]}
    assert any("\n\n" in w[0][0] for w in want.values() if w[0]) and runs
    for b, r in got.items():
        n = [(len(s[11]), s) for s in rows if s[0] == b and s[11]]
        assert r.mono_ratio == round(sum(k for k, s in n if ROLES[s[12]] == "code") / sum(k for k, _ in n), 4) and r.max_size == max(s[13] for _, s in n)


def test_no_spans(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert blocks.block_texts(empty).collect() == [] and blocks.protected_runs(empty).collect() == []
