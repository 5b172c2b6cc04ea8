"""Random pairs against a row-at-a-time reading of the rules, written apart from the library."""

from __future__ import annotations

import random
import re
import struct

from driftmark.operators.classify import FLAGS, classify_pairs
from tests.test_pairs import _model_layout

PARTS = ("yyyy", "yy", "mm", "dd", "hh", "mi", "ss", "sep")


def _float32(s):
    return struct.unpack("f", struct.pack("f", float(s)))[0]


def _int32(s):
    v = int(s)
    return v if -(2**31) <= v < 2**31 else 0


def _number(s):
    m = re.fullmatch(r"[+-]?([0-9]*)(\.?)([0-9]*)", s)
    if not m or not s:
        return None
    whole, dot, dec = m.groups()
    if dot and dec:
        return "float", len(whole), len(dec)
    if whole and not dot:
        return "int", len(whole), 0
    return None


def _numeric(a, b, flags):
    pa, pb = _number(a), _number(b)
    if pa is None or pb is None:
        return None
    if pa[0] == pb[0] == "int":
        if _int32(a) != _int32(b):
            return "derived"
        la, lb = len(a), len(b)
    else:
        if _float32(a) != _float32(b):
            return "derived"
        la, lb = pa[1], pb[1]
        if a != b:
            flags |= {"DelDecEnd"} if pa[2] > pb[2] else {"InsDecEnd"} if pa[2] < pb[2] else set()
    if a == b:
        return "sm"
    flags |= {"DelzBeg"} if la > lb else {"InszBeg"} if la < lb else set()
    return "numeric reformat"


def _components(s):
    layout = _model_layout(s)
    if layout is None:
        return None
    found = re.fullmatch(
        r"(?:(\d+)([-./])(\d+)[-./](\d+))?(?:^| |(?<=\d)$)?(?:(\d+):(\d+)(?::(\d+))?.*)?", s
    )
    x, sep, y, z, hh, mi, ss = found.groups()
    out = dict.fromkeys(PARTS)
    out.update(hh=hh, mi=mi, ss=ss, sep=sep)
    if layout != "time":
        order = {"ymd": (x, y, z), "mdy": (z, x, y), "dmy": (z, y, x), "ydm": (x, z, y)}[layout]
        year, out["mm"], out["dd"] = order
        out["yyyy" if len(year) == 4 else "yy"] = year
    return out


def _dates(a, b, flags):
    p, q = _components(a), _components(b)
    if (p is None) != (q is None):
        return "derived"
    if p is None:
        return None
    raised = set()

    def n(v):
        return int(v or 0)

    if p["yyyy"] and q["yyyy"] and n(p["yyyy"]) != n(q["yyyy"]):
        raised.add("YYYYChng")
    if p["yy"] and q["yy"] and n(p["yy"]) != n(q["yy"]):
        raised.add("YYChng")
    for one, other in ((p, q), (q, p)):
        bare = not other["yyyy"] and not other["yy"]
        if one["yyyy"] and bare:
            raised.add("YYYYChng")
        if one["yy"] and bare:
            raised.add("YYChng" if n(one["yy"]) else "YYFrmtChng")
    if p["yyyy"] and q["yy"]:
        raised.add("YYYYFrmtChng" if p["yyyy"][2:] == q["yy"] else "YYYYChng")
    if p["yy"] and q["yyyy"]:
        raised.add("YYFrmtChng" if q["yyyy"][2:] == p["yy"] else "YYChng")
    for part, name in (("hh", "Hr"), ("mm", "MM"), ("dd", "DD"), ("mi", "Min"), ("ss", "Sec")):
        x, y = p[part], q[part]
        if n(x) == n(y):
            if (x is None) != (y is None) or (x is not None and len(x) != len(y)):
                raised.add(f"{name}FrmtChng")
        elif x is not None and y is not None:
            half_day = part == "hh" and abs(n(x) - n(y)) == 12
            raised.add(f"{name}FrmtChng" if half_day else f"{name}Chng")
    if p["sep"] != q["sep"]:
        raised.add("DelimFrmtChng")
    if p == q:
        raised.add("DateFrmtChng")
    flags |= raised
    if any(not f.endswith("FrmtChng") for f in raised):
        return "derived"
    return "datereformat" if raised else None


def _masked(a, b):
    left = list(b)
    for c in a:
        if c in left:
            left.remove(c)
    return len(left) >= 2 and len(set(left)) == 1 and left[0] in "XYZ"


def _model(a, b, out):
    flags = set()
    if a and b and out:
        label = "concatenate" if a + b == out else "derivedconcat"
    else:
        label = "sm" if a == out else "not sm"
    if label == "concatenate":
        flags.add("Concat")
    label = _numeric(a, out, flags) or label
    if a != out:
        verdict = _dates(a, out, flags)
        if label == "not sm" and verdict:
            label = verdict
    if label == "not sm":
        blanks = "".join(map(chr, range(33)))
        if a.strip(blanks) == out.strip(blanks):
            label = "stringreformat"
            white = " \t\n\x0b\f\r"
            for end, strip in (("Beg", str.lstrip), ("End", str.rstrip)):
                la, lb = len(a) - len(strip(a, white)), len(out) - len(strip(out, white))
                flags |= {f"InsSp{end}"} if la < lb else {f"DelSp{end}"} if la > lb else set()
        elif _masked(a, out):
            label = "masking"
            flags.add("InsSame")
        else:
            label = "derived"
    return label, flags


def _texts(rng):
    """Dates, numbers, words, and damaged copies of them."""
    sep = rng.choice("-./")
    y = rng.choice(["2016", "16", "2000", "00", "1999", "99", "2012", "1500"])
    m = rng.choice(["1", "01", "2", "02", "12", "13", "6", "06", "0"])
    d = rng.choice(["5", "05", "28", "29", "30", "31", "32", "1", "12"])
    clock = rng.choice(["", "", "", " 10:30", " 22:30:00", " 9:05 AM", " 00:00:00", " 25:00", " 9:5:7"])
    date = sep.join(rng.choice([(y, m, d), (m, d, y), (d, m, y), (y, d, m)])) + clock
    number = rng.choice(["", "+", "-"]) + "0" * rng.randrange(3) + str(rng.randrange(300))
    number += rng.choice(["", "", ".", ".0", ".50", ".5", ".500"])
    word = "".join(rng.choice("abXYZ -9") for _ in range(rng.randrange(7)))
    return rng.choice([date, date, number, word, clock.strip(), ""])


def _damaged(rng, s):
    kind = rng.randrange(8)
    if kind == 0:
        return s
    if kind == 1:
        return " " * rng.randrange(3) + s + rng.choice(["", " ", "\t"])
    if kind == 2:
        return rng.choice("XYZ") * rng.randrange(4) + s[rng.randrange(3):]
    if kind == 3 and s:
        i = rng.randrange(len(s))
        return s[:i] + rng.choice("0123456789-/.: X") + s[i + 1 :]
    if kind == 4:
        return s.replace("-", "/")
    if kind == 5:
        return "0" + s
    return _texts(rng)


def test_random_pairs(spark):
    rng = random.Random(20)
    rows = []
    for i in range(20000):
        a = _texts(rng)
        b = rng.choice(["", "", "", _texts(rng)])
        out = a + b if rng.random() < 0.1 else _damaged(rng, a)
        rows.append((i, a, b, out))
    df = spark.createDataFrame(rows, "id int, i1 string, i2 string, o string")
    got = {r.id: r for r in classify_pairs(df, "i1", "i2", "o").collect()}
    labels = set()
    for i, a, b, out in rows:
        raised = {f[:-4] for f in FLAGS if got[i][f] == 1.0}
        assert (got[i].PredClassify, raised) == _model(a, b, out), (a, b, out)
        labels.add(got[i].PredClassify)
    assert len(labels) == 8
