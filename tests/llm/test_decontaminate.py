import random

from tastegrid.llm import decontaminate as dc

from .helpers import docs, prose


def distance(item, text):
    """Edits from item to the best substring of text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_best_distance_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        t = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 24)))
        got = dc.best_distance(p, t, len(p))
        assert got[0] == distance(p, t)
        assert (dc.best_distance(p, t, 1) is None) == (distance(p, t) > 1)


def edited(rnd, text, rate):
    s = list(text)
    for _ in range(int(rate * len(s))):
        k, a = rnd.randrange(len(s)), rnd.choice("sid")
        if a == "s":
            s[k] = rnd.choice("qxz")
        elif a == "d":
            del s[k]
        else:
            s.insert(k, rnd.choice("qxz"))
    return "".join(s)


def test_planted_items_are_found_and_others_not(spark):
    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.randint(14, 60))) for i in range(40)]
    rows, want = [], set()
    for i, t in items:
        for k, rate in enumerate((0, 0.02, 0.05)):
            d = 10 * i + k
            rows.append((d, prose(rnd, 50) + "\n" + edited(rnd, t, rate).upper().replace(" ", " ** ") + " " + prose(rnd, 50)))
            if dc.best_distance(" ".join(dc.normal_words(t)), " ".join(dc.normal_words(rows[-1][1])), int(0.1 * len(" ".join(dc.normal_words(t))))):
                want.add((d, i))
        rows.append((10 * i + 5, prose(rnd, 300)))
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_items(docs(spark, rows), bench(spark, items)).collect()}
    exact = {(d, i) for d, i in want if d % 10 == 0}
    assert exact <= got and got <= want and len(got) >= 0.97 * len(want)
    clean = dc.drop_contaminated(docs(spark, rows), bench(spark, items))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_edges(spark):
    rnd = random.Random(3)
    item = prose(rnd, 30)
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, prose(rnd, 30_000) + " " + item), (5, "a b c"), (6, item[: len(item) // 2])]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "a b c"), (None, item)]
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in dc.find_items(docs(spark, rows), bench(spark, items)).collect())
    # every item with a letter is searched, so three letters are found as well
    assert got == sorted([(d, i, 0) for d in ("3", "4", "None") for i in ("1", "None")] + [("5", "4", 0)])
    assert dc.find_items(docs(spark, []), bench(spark, items)).count() == 0
    assert dc.find_items(docs(spark, rows), bench(spark, [])).count() == 0
    assert dc.drop_contaminated(docs(spark, rows), bench(spark, [])).count() == len(rows)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, prose(rnd, 25)) for i in range(12)]
    rows = [(i, prose(rnd, 20) + " " + t) for i, t in items]
    monkeypatch.setattr(dc, "BLOCK_CHARS", 400)
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_items(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(i, i) for i in range(12)}


def every_third_word(text):
    """One character changed in every third word: no three words of the text follow each other unchanged."""
    words = text.split()
    for i in range(1, len(words), 3):
        words[i] = "q" + words[i][1:] if words[i][0] != "q" else "x" + words[i][1:]
    return " ".join(words)


def test_all_within_the_limit_are_found():
    rnd = random.Random(11)
    items = dc.Items([(i, prose(rnd, rnd.randint(4, 60))) for i in range(150)], dc.MAX_EDITS)
    for i, (_, item, limit) in enumerate(items.items):
        texts = [every_third_word(item), edited(rnd, item, 0.1), edited(rnd, item, 0.1).replace(" ", "")[: len(item)]]
        # as many edits as the limit allows, one in each piece but one
        cuts = [j * len(item) // (limit + 1) for j in range(limit + 2)]
        spare = rnd.randrange(limit + 1)
        texts.append("".join(item[a:b] if j == spare else "q" + item[a + 1:b] for j, (a, b) in enumerate(zip(cuts, cuts[1:]))))
        texts = [prose(rnd, 20) + " " + t + " " + prose(rnd, 20) for t in texts]
        got = {t: e for t, k, e, _, _ in dc._found(items, texts) if k == i}
        want = {t: distance(item, " ".join(dc.normal_words(x))) for t, x in enumerate(texts)} if len(item) >= dc.SHORT else {}
        assert got == {t: e for t, e in want.items() if e <= limit} or not want
        assert 3 in got or limit == 0


def test_copy_with_an_edit_in_every_third_word(spark):
    rnd = random.Random(12)
    items = [(i, " ".join(prose(rnd, 1) + "ing" for _ in range(30))) for i in range(20)]
    rows = [(i, prose(rnd, 40) + " " + every_third_word(t) + " " + prose(rnd, 40)) for i, t in items]
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.find_items(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(i, i, 10) for i in range(20)}


def test_long_texts_are_searched_in_parts(monkeypatch):
    rnd = random.Random(13)
    monkeypatch.setattr(dc, "PLACES", 64)
    monkeypatch.setattr(dc, "TEXT_CHARS", 500)
    monkeypatch.setattr(dc, "CANDIDATES", 3)
    words = [prose(rnd, 12) for _ in range(30)]
    items = dc.Items(list(enumerate(words)), dc.MAX_EDITS)
    texts = [prose(rnd, rnd.randint(0, 60)) + " " + edited(rnd, t, 0.05) for t in words] + [None, ""]
    spelled = [" ".join(dc.normal_words(t)) for t in texts]
    want = {(t, i, distance(item, x)) for t, x in enumerate(spelled) for i, (_, item, k) in enumerate(items.items)
            if distance(item, x) <= k}
    got = list(dc._found(items, texts))
    assert {g[:3] for g in got} == want and len(got) == len(want)
    assert all(dc.best_distance(words[i], " ".join(spelled[t].split()[w:]), e) for t, i, e, w, _ in got)


def test_short_items_and_scripts_without_blanks_are_found(spark):
    rnd = random.Random(14)
    question, capital, han = "What is the capital of France?", "Capital: Lima", "\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc"
    long_han = "".join(chr(0x4e00 + rnd.randrange(3000)) for _ in range(60))
    items = [(1, question), (2, capital), (3, han), (4, long_han), (5, "word")]
    rows = [(1, prose(rnd, 30) + " " + question + " " + prose(rnd, 30)), (2, "the capital, Lima is"), (3, "xcapital lima"), (4, "capital limas"),
            (5, "\u8bf7\u95ee" + han + "\u5462"), (6, "\u524d" + long_han[:20] + "\u524d\u524d" + long_han[21:] + "\u5462"), (7, "words sword"),
            (8, "a WORD!"), (9, "what was the capital of frances"), (10, "capitol lima")]
    got = {(r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in dc.find_items(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(1, 1, 0, 30), (2, 2, 0, 1), (5, 3, 0, 0), (6, 4, 2, 0), (8, 5, 0, 1), (9, 1, 2, 0)}
    clean = dc.drop_contaminated(docs(spark, rows), bench(spark, items))
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 7, 10}


def test_items_of_one_letter(spark):
    rows = [(1, "a cat"), (2, "cats"), (3, "A."), (4, "x 7 y"), (5, ""), (6, "77")]
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_items(docs(spark, rows), bench(spark, [(1, "a"), (2, "7"), (3, "?")])).collect()}
    assert got == {(1, 1), (3, 1), (4, 2)}
