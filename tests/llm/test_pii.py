"""Personal data: fixed patterns against plain regular expressions, discovery on planted contexts."""

import hashlib
import re

import numpy as np
import pytest

from mediaops.llm import pii
from mediaops.llm.common import prepare

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def run(spark, rows, tmp_path):
    prepare(spark)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, spans string, kind int, row long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return pii.op11_personal_data(spark, str(tmp_path)).collect()


def check_base(got, rows):
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append((g.base_sha256, g.n_email, g.n_ip, g.n_card, g.n_phone))
    want = {}
    for d, t in rows:
        b = base(t)
        want.setdefault(d, []).append((hashlib.sha256(b.encode()).hexdigest(), *(sum(s.startswith(k) for s in b.split(",")) for k in pii.KINDS)))
    assert {d: sorted(v) for d, v in by.items()} == {d: sorted(v) for d, v in want.items()}


ODD = ["a@b", "a@b.c@d.e", "@b.c", "x@-.-", "é.d@b.cé", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7", "256.1.1.1.2.3.4", "0001.002.3.04", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "41111111111111111111", "4111  1111 1111 1111",
    "+1 (2", "+1.2.3.4.5.6.7.8.9.0", "+12345678901", "+123456789", "+1234567890123456", "++12345678901-", "+1 234 567 8901 ) ", "+1\n2345678901", "00000000000000", "5.5.5.5@6.6", "a@1.2.3.4", "", None, " ", "+1 ( ) . -", "9" * 5000, "a" * 30000 + "@b.c", "1." * 4000]


def test_fixed_patterns(spark, tmp_path):
    r = np.random.default_rng(4)
    bits = ["@", ".", "-", " ", "+", "(", ")", "12", "4111111111111111", "a", "é", "\n", "7", "255", "300", "b.c", "x@y.z"]
    rows = list(enumerate([*ODD, *("".join(r.choice(bits, r.integers(2, 40))) for _ in range(1500))]))
    rows += [(None, "null@id.org"), (3, "same@id.org"), (3, "same@id.org")]
    check_base(run(spark, rows, tmp_path), rows)


def test_long_texts(spark, tmp_path):
    """Over six megabytes, with runs that would take a backtracking matcher a quadratic time."""
    text = "a" * 2_000_000 + " mail x.y@z.org " + "1" * 2_000_000 + " 10.0.0.1 " + "1 " * 500_000 + "@" * 100_000 + "é" * 500_000 + "+1 (555) 010-9999"
    rows = [(1, text), (2, "ok")]
    got = {g.doc_id: g for g in run(spark, rows, tmp_path)}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    mail, phone = text.index("x.y@"), text.index("+1 (")
    assert got[1].spans == f"email:{mail}:{mail + 9},ip:{text.index('10.0.')}:{text.index('10.0.') + 8},phone:{phone}:{len(text)}"


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def card(r):
    d = [4, *r.integers(0, 10, 14).tolist()]
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
    return "".join(map(str, [*d, -total % 10]))


def phone(r):
    return f"+1 ({r.integers(200, 999)}) {r.integers(200, 999)}-{r.integers(1000, 9999)}"


def test_discovery(spark, tmp_path):
    """Known shapes are found where the fixed patterns run two identifiers together, known contexts find
    identifiers of other forms; numbers in other places, and contexts that hold anything, are left alone."""
    r = np.random.default_rng(8)
    rows = [(i, f"Some words. Mobile phone: {phone(r)} and more of them, card {card(r)} it is.") for i in range(20)]
    rows += [(20 + i, f"write me an email: joe{i}@host{i}.org now") for i in range(20)]
    rows += [(40 + i, f"of the {w} and then") for i, w in enumerate([phone(r), phone(r), phone(r), "cat", "dog", "555-120-7788"])]
    joined = f"{phone(r)} {card(r)}"
    plain = {100: f"it was {joined} there", 101: "Mobile phone: 555-014-2233 thanks", 102: "an email: jane [at] corp [dot] com please", 103: "mobile PHONE : (0303) 44 55 66 ok", 104: "bad 4111111111111112 number", 105: "isbn 555-014-2233 here", 106: "look at corp.com today", 107: "nothing"}
    rows += list(plain.items())
    got = {g.doc_id: g for g in run(spark, rows, tmp_path)}
    check_base(got.values(), rows)
    text = {d: [(s.split(":")[0], plain[d][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[d].spans.split(",") if s] for d in plain}
    assert text[100] == [("phone", joined[:17]), ("card", joined[18:])]
    assert text[101] == [("phone", "555-014-2233")] and text[102] == [("email", "jane [at] corp [dot] com")] and text[103] == [("phone", "(0303) 44 55 66")]
    assert all(text[d] == [] for d in (104, 105, 106, 107)) and got[45].n_discovered == 0
    assert all(g.spans == base(dict(rows)[d]) for d, g in got.items() if d not in (100, 101, 102, 103))


def test_scores(spark):
    """The rounds against the same sums in Python."""
    prepare(spark)
    patterns = [(3, 11, 9.0, 9), (3, 20, 4.0, 8), (3, 31, 1.0, 3), (2, 20, 0.0, 8)]
    links = [(3, 11, 1, 1), (3, 20, 1, 1), (3, 20, 2, 2), (3, 31, 2, 2), (3, 31, 3, 1), (2, 20, 4, 1), (3, 31, 5, 1)]
    p = spark.createDataFrame(patterns, "kind int, pattern long, seen double, total long")
    edges = spark.createDataFrame(links, "kind int, pattern long, value long, n long")
    values = spark.createDataFrame([(3, 5)], "kind int, value long")
    _, sure = pii.scored(p, edges, values)
    got = {(r.kind, r.value): r.sure for r in sure.collect()}
    conf = {(k, v): 1.0 * ((k, v) == (3, 5)) for k, _, v, _ in links}
    for _ in range(pii.ROUNDS):
        trust = {(k, q): (seen + sum(n * conf[k, v] for k2, q2, v, n in links if (k2, q2) == (k, q))) / (total + 1) for k, q, seen, total in patterns}
        for k, v in conf:
            own = [(q, trust[k, q]) for k2, q, v2, _ in links if (k2, v2) == (k, v) and trust[k, q] >= pii.WEAK]
            shape, context = (max([0, *(t for q, t in own if q % 2 == odd)]) for odd in (1, 0))
            conf[k, v] = max(1 - (1 - shape) * (1 - context), 1.0 * ((k, v) == (3, 5)))
    want = {key: c for key, c in conf.items() if c >= pii.SURE}
    assert got == pytest.approx(want, abs=1e-3) and (3, 1) in got and (3, 5) in got
