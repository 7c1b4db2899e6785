"""Small documents that hold what the operators must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=8):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def prose(rng, n_lines=12):
    return "\n".join(" ".join(sentence(rng, rng.randint(4, 9)) for _ in range(rng.randint(1, 4))) for _ in range(n_lines))


def rows(seed=5, n=40):
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, a passage in several, empty and null texts, one long text."""
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 8) for _ in range(12))
    out = []
    for i in range(n):
        text = prose(rng)
        if i % 10 == 3:
            text = out[i - 1][1]
        if i % 10 == 5:
            w = out[i - 2][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 10 == 7:
            cut = text.index(". ") + 2
            text = text[:cut] + passage + " " + text[cut:]
        out.append((i, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(text)))
    k = n
    for text in ("", None, " \n\t ", "one", "one two three four", "One TWO three four", "É é É", prose(rng, 600), "x" * 50000):
        out.append((k, text, None, "c", len(text or "")))
        k += 1
    return out
