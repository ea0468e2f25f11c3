from __future__ import annotations

import random
import re

#: Rows with every odd case: nulls, empty and blank texts, ties, repeated rows, one long word, more columns.
ODD = [(None, "null id here and some more words to make ten words"), (90, None), (91, ""), (92, " \n\t "), (93, "x" * 5000), (94, "tie tie tie"), (94, "tie tie tie"), (95, "É ß 日本 🙂")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=40):
    """doc_id, text: invented prose with shared passages, copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [say(60) for _ in range(3)]
    out = []
    for i in range(n):
        w = say(rng.randint(1, 150))
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        out.append((i, "".join(x + rng.choice("      \n") for x in w).strip()))
    for i in range(8):  # copies, near copies, copies of near copies
        text = out[rng.randrange(n)][1].split(" ")
        if i % 2 and len(text) > 3:
            text[rng.randrange(len(text))] = "edited"
        out.append((n + i, " ".join(text)))
    return out


def frame(spark, rows, extra=True):
    """With columns whose names clash with those that the operators use."""
    if extra:
        return spark.createDataFrame([(*r, 7, "k", "w", "t") for r in rows], "doc_id bigint, text string, n bigint, key string, n_words string, __text string")
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def got(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def want(rows):
    return sorted(map(repr, rows))
