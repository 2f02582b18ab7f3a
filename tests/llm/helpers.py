"""Small inputs with every awkward case, and their comparison with plain Python."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "straße", "maß", "niño", "the", "of", "token:", "x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(40)
    line = "A line that many documents hold, word for word."
    texts: list[str | None] = [None, "", "\n", "\n\n\n", "x", "   ", "\t\x0b\x0c\r \n", say(3), say(5), say(19), say(20), say(21)]
    texts += [shared, shared, f"{say(8)} {shared} {say(9)}", f"{line}\n{say(12)}", f"  {line.upper()}\t\n{say(7)}", f"{line}\n{line}\n{say(30)}"]
    texts += ["a " * 60, "😀 émoji 😀 " * 30, say(4000), "nolinebreak" * 500, say(200), " nbsp ", " separator "]
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(300)]
    for k in range(6):
        near = list(base)
        near[50 * k + 10] = f"changed{k}"
        texts.append(" ".join(near))
    return texts


def documents(spark, texts=None, extra: bool = False):
    """Rows with ids, some repeated and one missing; with ``extra`` also columns whose names operators use themselves."""
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s0", "s1"][min(i % 4, 2)], None if t is None else len(t)) for i, t in enumerate(texts)]
    if rows and len(rows) > 4:
        rows += [rows[-1], rows[-1], (None, texts[-2], "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("pos", "sig", "words", "kept", "h1", "key", "id", "found", "spans", "kinds", "terms", "at", "bin", "block", "start"):
            df = df.selectExpr("*", f"'z' AS {name}")
    return df


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
