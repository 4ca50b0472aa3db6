"""Made-up running text for tests."""

import random

SYLLABLES = "ba de fi go lu me ni po ra su ta ve wi yo zu kla tre sto".split()
FILL = "the and of to in is that for it with was on as by".split()


def sentences(seed: int, words: int = 120) -> str:
    r = random.Random(seed)
    out = []
    for k in range(words):
        fill = r.random() < 0.35
        word = r.choice(FILL) if fill else "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))
        out.append(word.capitalize() if k % 12 == 0 else word + "." * (k % 12 == 11))
    return " ".join(out)
