import re
from collections import Counter

from seglark.llm import line_rules


def by_hand(rows, max_docs, least):
    lines_of = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    often = Counter((host, line) for host, line, _ in {(host, norm(x), i) for i, t, host in rows for x in lines_of(t)})
    out = []
    for i, t, host in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
        lines = lines_of(t)
        gone = [norm(x) for x in lines if often[host, norm(x)] > max_docs]
        total = sum(len(norm(x)) for x in lines)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, len(gone), sum(map(len, gone)), not failed and total - sum(map(len, gone)) >= least * total))
    return sorted(out, key=str)


def test_by_hand(spark, edges, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edges.collect()]
    rows += [(100 + i, f"Common  line {i}\nown text number {i} with several words in it for sure\nCOMMON line {i % 2}", "a" if i % 3 else None) for i in range(12)]
    rows += [(200 + i, f"Common line {i}", "a") for i in range(3)]
    rows += [(250 + i % 2, f"repeated rows of one document\nown text number {i} with several words in it for sure", "b") for i in range(20)]
    rows += [(None, f"rows without a document\nown text number {i} with several words in it for sure", "b") for i in range(5)]
    rows += [(300, "one two three four five six " * 2 + "a # b $ c", "b"), (301, "a b c d e f a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in line_rules.judge(docs, 3, 0.5).collect()), key=str)
    assert got == by_hand(rows, 3, 0.5)
    assert line_rules.judge(empty).count() == 0
    assert line_rules.judge(edges).count() == edges.count()


def test_no_python_in_the_plan(spark, edges):
    plan = line_rules.judge(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
