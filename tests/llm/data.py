"""Documents with everything that can be wrong with them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int, r int, h int, pos int, a int, b int, w int, fp int, v int, key int, th int, lines int, s int"
CLASH = ("x", *[1] * 13)


def documents(seed=3, n=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda m: "\n".join(" ".join(rnd.choices(vocab, k=8)) for _ in range(m))
    rows = [(i, text(rnd.randrange(1, 30))) for i in range(n)]
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, rows[5][1].replace("w1 ", "zz ", 1))]  # copies
    rows += [(n + 3, None), (n + 4, ""), (n + 5, " \n\t "), (n + 6, "one"), (n + 7, "é ß Œuvre ﬁ"), (n + 8, text(2500))]
    rows += [(n + 9, "same\nsame\nsame\nsame\nsame\nsame"), (n + 10, rows[7][1]), (n + 10, rows[7][1]), (None, text(12)), (None, None)]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *CLASH) for i, t in rows], SCHEMA)
