import re

from callgrain.llm import line_dedup as op

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (5, "A shared line here\nown words of five\nx\n\n  a SHARED line here\t\r\nlast"), (2, "a shared line here\nend\n"), (3, None), (4, ""),
    (7, "a shared line here"), (8, "ÄÖ shared line\nän own thing\n\x0bäö shared line"), (9, "äö shared line\nÄÖ shared line"), (2, "a shared line here\nend\n"),
    (None, "a shared line here"), (11, "twice in one text\ntwice in one text"), (12, "short\nshort\nninechars\ntencharsss"), (13, "ninechars\ntencharsss\n"),
    (14, "\n".join(f"line number {i // 2}" for i in range(4000))), (15, "\n".join(f"line number {i}" for i in range(3000, 0, -2))),
] + [(100 + i, f"the common header\nbody {i}\nthe common footer") for i in range(60)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 3, "y") for i, t in rows], "doc_id long, text string, n_lines int, mark_runs string")
    return sorted(map(tuple, op.drop_repeated_lines(df).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_HOT", 3)
    assert run(spark, ROWS) == brute(ROWS)


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(i, t, 3, "y") for i, t in ROWS], "doc_id long, text string, lines_of_text int, mark_runs string")
    out, n_lines, n_dropped = op.clean_texts(df)
    assert out.columns[:4] == df.columns and len(set(out.columns)) == 6
    assert {(r["lines_of_text"], r["mark_runs"]) for r in out.collect()} == {(3, "y")}
    assert out.where("doc_id = 3").first()["text"] is None


def test_empty(spark):
    assert run(spark, []) == []
