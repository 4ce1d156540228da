import random

import pytest


def word(rng, n=400):
    return "w" + "".join(rng.choice("abcdefghij") for _ in range(2)) + str(rng.randrange(n) % 17)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd spacing, many scripts, empty ones and nulls."""
    rng = random.Random(7)
    base = [" ".join(word(rng) for _ in range(rng.randrange(5, 260))) for _ in range(60)]
    passage = " ".join(word(rng) for _ in range(90))
    out = list(base)
    out += base[:8]  # exact copies
    for text in base[8:24]:  # near copies
        words = text.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = word(rng)
        out.append(" ".join(words))
    out += [f"{base[i][:200]}\n{passage}\n{base[i + 1][:150]}" for i in range(20, 32)]  # a shared passage
    out += ["", "", None, None, "   \n\t ", "a", "aaaa " * 400, "x" * 3000, "é😀 ñ " * 200, "same line\n" * 100, "one two three four", " non breaking 　space", "<|endoftext|> it's 12 o'clock  \n\n tabs\t\tand  spaces  "]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "k", "d", 0.5) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id " * 5, "en", "s0", 1, 0, "k", "d", 0.5), (3, texts[3], "en", "s0", 1, 0, "k", "d", 0.5)]  # a null id, and a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash long, _key string, digest string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
