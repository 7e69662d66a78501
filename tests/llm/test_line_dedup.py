import random

from tastegrid.llm import line_dedup as ld

from .helpers import docs


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    order = lambda d: (d is None, d or 0)
    first, held = {}, {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= 10:
                first[k] = min(first.get(k, d), d, key=order)
                held.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) > 1 and first[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    got = ld.dedup_lines(docs(spark, rows), **more).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=str)


ROWS = [(5, "Shared line here\nown five line"), (3, "  SHARED LINE HERE\t\nshared line here\n\n"), (9, "shared line here"),
        (None, "shared line here\nonly null line"), (None, None), (7, ""), (7, "\n\n"), (8, "short\nshort"), (4, "short"),
        (3, "  SHARED LINE HERE\t\nshared line here\n\n"), (6, "ÉCOLE LIGNES LA\nÉcole lignes la"), (2, "École lignes la"),
        (10, "\n".join(f"line number {i % 150}" for i in range(300))), (11, "\n".join(f"line number {i}" for i in range(200)))]


def test_lines(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_heavy_lines_are_dealt_by_document(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice(["a very common line", "another line of text", f"own line of {i} {k}"]) for k in range(5)))
            for i in range(300)]
    monkeypatch.setattr(ld, "HEAVY_SHARE", 1_000_000)  # every key is heavy
    assert run(spark, rows) == brute(rows)
    assert run(spark, ROWS) == brute(ROWS)


def test_bitmaps_and_edges(spark):
    assert run(spark, []) == []
    rows = [(1, "first shared line\nx"), (2, "x\nfirst shared line")]
    bits = ld.drop_bitmaps(docs(spark, rows)).collect()
    assert [(r["doc"], list(r["drops"])) for r in bits] == [(2, [2])]
    df = spark.createDataFrame([(1, "t" * 12, 5, "z")], "doc_id bigint, text string, n_lines int, drops string")
    assert ld.dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_dropped", "drops"]


def test_texts_are_cut_into_lines_once(spark):
    plan = ld.drop_bitmaps(docs(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
