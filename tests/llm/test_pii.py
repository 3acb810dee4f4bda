import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seglark.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
HARD = ["a@b.c_d@e.f.g and x@y..z", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "4111 1111-1111 1111, 4111111111111112 é", "call +1 (988) 555-2485 or +12345678. +1 2", "é@x.com éa@x.com", "9" * 3000, "1 " * 9000, "a.b@" * 500, "+1-" * 2000, "+4111 1111 1111 1111 9", "x" * 50_000 + "@y.z", "1.1.1.1 " * 2000]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in BASE.items()}
    return found, [f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans]


def test_base_spans(spark, edges):
    rows = [(i, t) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges.select("doc_id", "text"))
    texts = sorted(t or "" for _, t in ((r["doc_id"], r["text"]) for r in docs.collect()))
    got = sorted((tuple(r) for r in pii.report(docs).drop("doc_id").collect()), key=str)
    expected = []
    for t in texts:
        found, spans = by_hand(t)
        expected.append((*(len(found[k]) for k in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    assert got == sorted(expected, key=str)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words before contact address user{i}@mail.example.com thanks and more") for i in range(12)]
    rows += [(100 + i, f"please use contact address jo{i}99-at-mail-example thanks a lot") for i in range(2)]
    rows += [(200 + i, f"in the year 19{i}7-{i} there were many things") for i in range(9)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(2):
        text = dict(rows)[100 + i]
        (span,) = got[100 + i]["spans"].split(",")
        kind, a, b = span.split(":")
        assert kind == "email" and text[int(a) : int(b)] == f"jo{i}99-at-mail-example" and got[100 + i]["n_email"] == 0
    assert all(got[200 + i]["spans"] == "" for i in range(9))
    assert all(got[i]["n_email"] == 1 and got[i]["spans"].count(",") == 0 for i in range(12))


def test_mask(spark, edges, empty):
    masked = pii.mask(edges)
    assert masked.columns == edges.columns and masked.count() == edges.count()
    by = {r["doc_id"]: r for r in masked.collect()}
    assert by[9]["text"] == "mail me: [EMAIL] or [PHONE], card [CARD], host [IP]"
    assert by[9]["n_chars"] == len(by[9]["text"]) and by[2]["text"] is None and by[10]["text"].startswith("ünï")
    assert pii.mask(empty).count() == 0 and pii.report(empty).count() == 0


def test_overlapping_kinds_are_masked_once(spark):
    docs = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y"), (2, "10.0.0.1@mail.example.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert got[1] in ("x [CARD] y", "x +[CARD] y", "x [PHONE] y") and got[2] == "[EMAIL]"


def test_running_sums(spark):
    n = 1000
    row = spark.createDataFrame([(list(range(n)),)], "v array<int>").select(pii.running_sums(F.col("v")).alias("s")).first()
    assert row["s"] == [i * (i + 1) // 2 for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "no data"])
def test_nothing(spark, text):
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()


UNSEEN = [
    ("jo199-at-mail-example", " thanks"), ("jo299-at-mail-example", ". Thanks"), ("AB12345", "."), ("AB-12346", "- yes"), ("CD77", ""), ("jo399-at-mail-example", ""),
    ("kim@localhost", " thanks"), ("kim.lee@localhost", "."), ("jo-at-mail-example", ""), ("x" * 100 + "-12", " thanks"), ("a1" + "b" * 90 + "2", ". Thanks"),
]


def test_unseen_identifiers_before_marks_without_digits_and_long_ones(spark):
    rows = [(i, f"some words before contact address user{i}@mail.example.com thanks and more") for i in range(60)]
    rows += [(100 + i, f"please use contact address {mark}{x}{after}") for i, (x, after) in enumerate(UNSEEN) for mark in ["-(" if i % 2 else ""]]
    rows += [(200, "please use contact address soon. Thanks"), (201, "a." * 20_000 + " and -" + "%" * 20_000), (202, "contact address x1.2 thanks")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (x, _) in enumerate(UNSEEN):
        kind, a, b = got[100 + i].split(":")
        assert kind == "email" and dict(rows)[100 + i][int(a) : int(b)] == x
    assert got[200] == got[201] == ""
    assert pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 102").first()["text"] == "please use contact address [EMAIL]."


def words_around(text, start, end):
    """Last two words before and first word after, by hand."""
    letters = r"[^\W\d_]+"
    left, right = re.findall(letters, text[:start].lower()), re.findall(letters, text[end:].lower())
    return (left[-2] if len(left) > 1 else "", left[-1] if left else "", right[0] if right else "")


def test_contexts_have_no_limit(spark, monkeypatch):
    gaps = ["", " ", " " * 5, "-" * 70, "." * 300, "1 " * 1500]
    words = ["a", "word", "w" * 100, "é" * 1000]
    rows = [(f"{w} first{g}second{h}", f"{h}third{w}") for w in words for g in gaps[1:] for h in gaps]
    rows = [(left + "@" + right, len(left), len(left) + 1) for left, right in rows] + [("@", 0, 1), ("a@b", 1, 2), ("a b@", 3, 4), ("  @  ", 2, 3)]
    df = spark.createDataFrame(rows, "text string, start int, end int")
    for near in ((80, 800), (3, 9)):
        monkeypatch.setattr(pii, "NEAR", near)
        got = df.select("text", "start", "end", pii.before_span(F.col("text"), F.col("start")).alias("l"), pii.after_span(F.col("text"), F.col("end")).alias("r")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["l"]["a"], r["l"]["b"], r["r"]) == words_around(r["text"], r["start"], r["end"])


def graph_by_hand(edges, rounds=pii.ROUNDS, min_seeds=pii.MIN_SEEDS, confidence=pii.CONFIDENCE):
    """Discovered value -> kind from (kind or None, value, pattern) edges."""
    edges = set(edges)
    seeded = {(p, k) for k, _, p in edges if k and len({v for j, v, q in edges if (j, q) == (k, p)}) >= min_seeds}
    score = {}
    for _ in range(rounds):
        trust = {}
        for p, k in seeded:
            of = {}
            for j, v, q in edges:
                if q == p:
                    known = score.get((v, k), 0.0) if j is None else float(j == k)
                    of[v] = max(of.get(v, 0.0), known)
            trust[p, k] = sum(of.values()) / (len(of) + pii.SMOOTH)
        score = {}
        for j, v, q in edges:
            for p, k in seeded:
                if j is None and p == q:
                    score[v, k] = max(score.get((v, k), 0.0), trust[p, k])
    out = {}
    for v in {v for v, _ in score}:
        best = max(pii.KINDS, key=lambda k: (score.get((v, k), -1.0), -pii.KINDS.index(k)))
        if score.get((v, best), -1.0) >= confidence:
            out[v] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    edges = []
    for p in range(8):
        kinds = rng.choices([*pii.KINDS, None], [8 if rng.random() < 0.4 else 0, 3 if rng.random() < 0.4 else 0, 1, 9 if rng.random() < 0.3 else 0, 1.5], k=24)
        edges += [(k, f"{k or 'c'}{rng.randrange(12)}", f"p{p}") for k in kinds]
    edges += [("email", f"e{i}", "sure") for i in range(20)] + [(None, f"new{i}", "sure") for i in range(2)] + [(None, "new0", "other"), ("ip", "i1", "other")]
    found = spark.createDataFrame([(k, v, [p]) for k, v, p in edges], "kind string, value string, patterns array<string>")
    got = {r["value"]: r["kind"] for r in pii.discover(found).collect()}
    assert got == graph_by_hand(edges) and got["new0"] == got["new1"] == "email"


def test_no_python_in_the_plan(spark, edges):
    for df in (pii.report(edges), pii.mask(edges)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
