"""Small tables with copies, near copies, nulls, odd texts and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, sid long, key string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.25:
            base = rng.choice([t for t in texts if t]).split(" ")
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 60, 150, 400]))
            if rng.random() < 0.3:
                words[rng.randrange(len(words)) : 0] = [passage]
            texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ", "]) for w in words).strip())
    texts += ["", "   \n\t ", None, "One", "one TWO", "one two", "a b c", "A B C", "x " * 3000, "q\x00r \x01s", "日本 語 の 文"]
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[3], rows[3], (None, texts[0]), (None, "unlike all others here"), (rows[5][0], "same id, other text " * 5)]
    return rows


def frame(spark, rows, partitions=3):
    full = [(i, t, "en", "s", None if t is None else len(t), "r", "w", 1, "k") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def multiset(rows):
    return sorted(rows, key=repr)
