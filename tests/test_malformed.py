"""Generated patterns against a plain parser, on hand-made and generated lines."""

from __future__ import annotations

import math
import re
import unicodedata

import pytest

from gramforge.operators import malformed

NUM = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.A)


def number(s, positive=True):
    if not NUM.fullmatch(s) or not math.isfinite(float(s)):
        return False
    return positive or float(s) < 0 or (float(s) == 0 and not re.search("[1-9]", s.lower().split("e")[0]))


def count(s):
    return bool(re.fullmatch(r"[0-9]+", s)) and int(s) < 2**63


def word(w):
    return w and not any(unicodedata.category(c) == "Cc" or c == "�" for c in w)


def csv_fields(s):
    out, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = s.find('"', j)
                if k < 0:
                    return None
                text += s[j:k]
                if s[k + 1 : k + 2] == '"':
                    text += '"'
                    j = k + 2
                else:
                    i = k + 1
                    break
            out.append(text)
            if i < len(s) and s[i] != ",":
                return None
        else:
            k = s.find(",", i)
            k = len(s) if k < 0 else k
            if '"' in s[i:k]:
                return None
            out.append(s[i:k])
            i = k
        if i >= len(s):
            return out
        i += 1


def judge(fmt, k, no, raw):
    """(status, reason) by plain parsing."""
    if raw is None:
        return "skipped", None
    s = raw.rstrip(" \r")
    if not s.strip(" \t") or s.startswith("#") or (fmt == "csv" and no == 1):
        return "skipped", None
    if fmt not in ("counts", "arpa", "csv"):
        return "failed", "value"
    if k is None or k < 1:
        return "failed", "quoting" if fmt == "csv" and csv_fields(s) is None else "columns"
    if fmt == "counts":
        f = re.split(r"[ \t]+", s)
        if len(f) != k + 1 or "" in f:
            return "failed", "columns"
        ok = all(map(word, f[:-1])) and count(f[-1])
    elif fmt == "arpa":
        f = s.split("\t")
        words = [w for w in f[1].split(" ") if w] if len(f) > 1 else []
        if len(f) not in (2, 3) or len(words) != k:
            return "failed", "columns"
        ok = number(f[0], False) and all(map(word, words)) and (len(f) == 2 or number(f[2]))
    else:
        f = csv_fields(s)
        if f is None:
            return "failed", "quoting"
        words = [w for w in re.split(r"[ \t]+", f[1]) if w] if len(f) > 1 else []
        if len(f) != 5 or len(words) != k:
            return "failed", "columns"
        ok = re.fullmatch(f"0*{k}", f[0]) and "\t" not in f[1] and all(map(word, words))
        ok = ok and number(f[2], False) and (not f[3] or number(f[3])) and count(f[4])
    return ("loaded", None) if ok else ("failed", "value")


LINES = [
    ("counts", 2, 3, "a b 5"), ("counts", 2, 3, "a \t b\t\t007 \r"), ("counts", 2, 3, "a b"), ("counts", 1, 3, "a -1"), ("counts", 1, 3, "a １２"),
    ("counts", 1, 3, f"a {2**63 - 1}"), ("counts", 1, 3, f"a {2**63}"), ("counts", 1, 3, "a 00000000000000000000000000000012"), ("counts", 1, 3, "a 0"),
    ("counts", 1, 3, "a 000"), ("counts", 1, 1, "a 1"), ("counts", 7, 3, "a b c d e f g 1"), ("counts", 7, 3, "a b c d e f 1"), ("counts", None, 3, "a 1"),
    ("counts", 1, 3, "a\x00b 1"), ("counts", 1, 3, "a� 1"), ("counts", 1, 3, "a\xa0b 1"), ("counts", 1, 3, "#a 1"), ("counts", 1, 3, ""),
    ("counts", 1, 3, None), ("counts", 1, 3, "  \r"), ("counts", 1, 3, "\t"), ("counts", 1, 3, " a 1"), ("counts", 0, 3, "1"), ("counts", 1, 3, "a 1_000"),
    ("arpa", 2, 3, "-0.5\ta b\t0.1"), ("arpa", 2, 3, "-0.5\ta b"), ("arpa", 2, 3, "-0.5\ta b\t"), ("arpa", 2, 3, "-0.5\ta b\t0.1\t2"), ("arpa", 2, 3, "-0.5 a b"),
    ("arpa", 1, 3, "0.5\ta"), ("arpa", 1, 3, "0\ta"), ("arpa", 1, 3, "-0.0\ta"), ("arpa", 1, 3, "+0e9\ta"), ("arpa", 1, 3, "-1e999\ta"), ("arpa", 1, 3, "-inf\ta"),
    ("arpa", 1, 3, "-1\ta\t1e999"), ("arpa", 1, 3, "-1\ta\t1e300"), ("arpa", 1, 3, "-.5E-3\ta\t+5."), ("arpa", 1, 3, "−0.5\ta"), ("arpa", 1, 3, "-1\t\t1"),
    ("arpa", 9, 3, "-1\ta b c d e f g h i\t1"), ("arpa", 1, 3, "-1"), ("arpa", 1, 3, "-1\ta\x1bb"), ("arpa", 1, 3, "-\ta"), ("arpa", 1, 3, "2e-1\ta"),
    ("csv", 2, 3, "2,a b,-0.5,,3"), ("csv", 2, 3, '"2","a b","-0.5","","3"'), ("csv", 2, 3, '2,"a,b ""c""",-0.5,0.1,3'), ("csv", 2, 3, '2,a"b c,-0.5,,3'),
    ("csv", 2, 3, '2,"a b,-0.5,,3'), ("csv", 2, 3, '2,"a b"x,-0.5,,3'), ("csv", 2, 3, "2,a b,-0.5,3"), ("csv", 2, 3, "2,a,-0.5,,3"), ("csv", 2, 3, "3,a b,-0.5,,3"),
    ("csv", 2, 3, "2,a b,0.5,,3"), ("csv", 2, 3, "2,a b,-0.5,x,3"), ("csv", 2, 3, "2,a b,-0.5,,"), ("csv", 2, 1, "2,a b,bad"), ("csv", 2, 3, '2,"",-0.5,,3'),
    ("csv", 1, 3, '1,"""",-0.5,,3'), ("csv", 1, 3, '1,"a""",-0.5,,3'), ("csv", 1, 3, '"'), ("csv", 1, 3, ","), ("csv", 2, 3, "2,a\tb,-0.5,,3"), ("csv", 8, 3, "8,a b c d e f g h,-1,,1"),
    ("other", 1, 3, "a 1"), (None, 1, 3, "a 1"), ("csv", 1, 3, '1,"' + 'a""' * 20_000 + '",-1,,1'), ("counts", 1, 3, "a" * 100_000 + " 1"), ("arpa", 3, 3, "-1\t" + "w " * 50_000),
]


def _check(spark, lines):
    rows = [(i, f, k, n, r, "extra") for i, (f, k, n, r) in enumerate(lines)]
    df = spark.createDataFrame(rows, "line_id long, fmt string, ord int, line_no int, raw string, reason string")
    got = {r.line_id: r for r in malformed.parse_lines(df, ["line_id"]).collect()}
    assert len(got) == len(rows)
    for i, line in enumerate(lines):
        assert (got[i].status, got[i].reason) == judge(*line), str(line)[:200]
    return got


def test_lines(spark):
    got = _check(spark, LINES)
    by = {str(line): got[i] for i, line in enumerate(LINES)}
    r = by[str(("csv", 2, 3, '2,"a,b ""c""",-0.5,0.1,3'))]
    assert (r.ngram, r.cnt, r.log10prob, r.log10bow) == ('a,b "c"', 3, -0.5, 0.1)
    r = by[str(("counts", 2, 3, "a \t b\t\t007 \r"))]
    assert (r.ngram, r.cnt, r.log10prob) == ("a b", 7, None)
    assert by[str(("arpa", 1, 3, "-1\ta\t1e999"))].field is None
    assert by[str(("csv", 2, 3, "2,a b,0.5,,3"))].field == "log10prob"
    assert by[str(("csv", 2, 3, "2,a b,-0.5,x,3"))].field == "log10bow"
    assert by[str(("counts", 1, 3, "a -1"))].field == "cnt"


def test_generated_lines(spark):
    import random

    rng = random.Random(11)
    seeds = [x for x in LINES if x[3] is not None and len(x[3]) < 200]
    lines = []
    for _ in range(3000):
        f, k, n, raw = rng.choice(seeds)
        s = list(raw)
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(s))
            if rng.random() < 0.4 and s:
                del s[min(at, len(s) - 1)]
            else:
                s.insert(at, rng.choice(' \t,"a1-.e0#\r\x07'))
        text = "".join(s)
        if "\t" in text[-3:] and f != "arpa":
            continue  # whether a tab at the end counts is not defined
        lines.append((f, k, n, text))
    _check(spark, lines)


def test_at_most():
    for limit in (0, 7, 10, 99, 120, 2**63 - 1):
        p = re.compile(malformed.at_most(limit).replace("0*+", "0*").replace("(?<=0)", "(?<=0)"))
        for n in {0, 1, limit - 1, limit, limit + 1, limit * 10, limit // 10} - {-1}:
            for text in (str(n), "00" + str(n)):
                assert bool(p.fullmatch(text)) == (n <= limit), (limit, text)


def test_no_lines(spark):
    df = spark.createDataFrame([], "line_id long, fmt string, ord int, line_no int, raw string")
    assert malformed.parse_lines(df, ["line_id"]).collect() == []


