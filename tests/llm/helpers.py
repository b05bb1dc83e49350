"""Small document frames with the awkward cases that every operator meets."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, **columns):
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    return frame(spark, rows)


def prose(rng: random.Random, n: int) -> str:
    syllables = ["tha", "ing", "er", "on", "re", "st", "ou", "ble", "wh", "né", "ti"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "ß é 日本", "word " * 3, "x" * 3000, "one two three four five", "tab\tand\x0bthe\x0crest\r\nend"]
