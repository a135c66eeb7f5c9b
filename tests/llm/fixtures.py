"""Small hard documents: nulls, blanks, copies, long texts, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, n string, block long, sum long, hash long, spans string, sha string, base long"
SYLLABLES = ["an", "the", "ri", "ou", "é", "st", "ing", "Ka", "ß", "lo"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def texts(seed=3, n=60):
    """Random prose with near copies, shared passages and edge cases."""
    rng = random.Random(seed)
    shared = prose(rng, 50)
    out = [None, "", " \n\t ", "one", "one two", "Ünï çødé 日本語のテキスト 🙂", "a\x1cb\x00c", "<|endoftext|> x<|startoftext|>y"]
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(n)]
    for i, text in enumerate(base):
        words = text.split(" ")
        if i % 4 == 0:
            for _ in range(3):
                copy = list(words)
                for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                    copy[rng.randrange(len(copy))] = word(rng)
                out.append(" ".join(copy))
        if i % 5 == 0:
            text = " ".join(words[: len(words) // 2]) + " " + shared + " " + " ".join(words[len(words) // 2 :])
        out.append(text)
    out += [base[0].upper(), base[1], base[1], prose(rng, 6000), "x" * 5000]
    return out


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "n", 2, 3, 4, "s", "h", 5) for i, t in rows], SCHEMA)


def documents(spark, rows=None):
    return frame(spark, list(enumerate(texts())) if rows is None else rows)
