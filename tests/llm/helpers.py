"""Small tables and brute-force helpers for the operator tests."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra=""):
    """Documents from (doc_id, text, ...) rows; lang, source and n_chars are filled."""
    full = [(r[0], r[1], "en", "s", len(r[1] or ""), *r[2:]) for r in rows]
    return spark.createDataFrame(full, DOCS + extra)


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rnd.randint(1, 4)))
                    for _ in range(n))
