"""Small documents with everything that may go wrong, and plain word splitting."""

import random
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile("[^\x20\x09-\x0d]+")
LETTERED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

SCHEMA = "text string, n_words int, doc_id long, start int, lang string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Sentences of invented words, some on lines of their own."""
    rng = random.Random(seed)
    words = []
    for i in range(n):
        w = "".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 3)))
        w += str(rng.randrange(vocabulary) % 7)
        if i % 9 == 8:
            w += "." if rng.random() < 0.6 else ".\n"
        words.append(w.capitalize() if rng.random() < 0.1 else w)
    return " ".join(words).replace("\n ", "\n")


def rows(texts):
    """Rows with clashing extra columns; the list gives (doc_id, text)."""
    return [(t, 7, i, 3, None if i == 1 else "en") for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def odd_texts():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, odd characters."""
    base = prose(1, 120)
    return [
        (0, base), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, base), (6, base.upper()),
        (None, base), (None, None), (7, "a b c d e f"), (8, "a b c d e f"), (9, prose(2, 3000)),
        (10, "É ñ 漢字 <|endoftext|> it's \x1c x y  z"), (11, ". . . !"), (12, "word " * 200),
    ]
