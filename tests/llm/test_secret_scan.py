import hashlib
import re

from anamnesis.llm import secret_scan as sec
from tests.llm.common import frame, given

KEY = "AKIA" + "Q7Z2" * 5
PATTERNS = [
    (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(PATTERNS) for m in p.finditer(text or "") if good(m))


def listed(spans):
    return ",".join(f"{sec.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def expected(rows):
    """rows: id, text, source."""
    owners = {}
    for _, text, source in rows:
        for _, _, _, value in sec.candidates(text or ""):
            owners.setdefault(value, set()).add((source or "").split("/")[0])
    out = []
    for doc_id, text, _ in rows:
        base = base_spans(text)
        live = [(s, k, e) for s, k, e, v in sec.candidates(text or "") if k == 3 and len(owners[v]) < sec.EXAMPLE_OWNERS]
        out.append((doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + live))))
    return out


def same(df, rows):
    assert sorted(repr(tuple(r)[:6]) for r in sec.find_secrets(df).collect()) == sorted(map(repr, expected(rows)))


ROWS = [
    (1, None, "a/x"), (2, "", "a/x"), (3, f"é😀 password = 'hunter22' {KEY} " + "0f" * 13, "b/y"), (4, "secret: token: abcdefgh  TOKEN=abcdef", "a"),
    (5, "ſecret=abcdefgh api_Key:x23456 api__key=123456", "c"), (6, "AKIA" * 6 + " AKIAshort", None), (7, "q" * 300_000 + " token=zzzzzz", "d"),
    (8, "ghp_Ab3dE5gH7jK9mN1pQ3sT5vX7z copied", "e/1"), (8, "ghp_Ab3dE5gH7jK9mN1pQ3sT5vX7z copied", "e/1"), (None, "ghp_Ab3dE5gH7jK9mN1pQ3sT5vX7z", "e/2"),
]


def test_rows(spark):
    same(frame(spark, ROWS), ROWS)
    assert sec.find_secrets(frame(spark, [])).collect() == []


def test_widely_copied_values_are_examples(spark):
    live, copied = "ghp_Ab3dE5gH7jK9mN1pQ3sT5vX7z", "ghp_Zz9dE5gH7jK9mN1pQ3sT5vX7q"
    rows = [(i, f"key {copied} end token=sample12", f"owner{i}/r") for i in range(9)] + [(i, f"mine {live} token=own{i}own{i}", "me/r") for i in range(9, 13)]
    got = {r["doc_id"]: r for r in sec.find_secrets(frame(spark, rows)).collect()}
    assert all("live" not in got[i]["spans"] and got[i]["n_example"] == 1 for i in range(9))
    assert all("live:5:34" in got[i]["spans"] for i in range(9, 13))
    same(frame(spark, rows), rows)
    clean = {r["doc_id"]: r["text"] for r in sec.redact(frame(spark, rows)).collect()}
    assert clean[0] == rows[0][1] and clean[9] == "mine [SECRET] [SECRET]"


def test_redaction_joins_overlaps_and_keeps_rows(spark):
    rows = ROWS + [(20, "é token=" + "0a" * 20 + " b", "z")]
    out = sec.redact(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in out.collect())
    assert len(got) == len(rows) and ("20", "é [SECRET] b") in got and ("1", "") in got


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, [(r["doc_id"], r["text"], r["source"]) for r in rows])
