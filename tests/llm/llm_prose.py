"""Invented prose."""

import random

WORDS = "the of and to in a is that for it was on with as by at from house river stone cloud winter paper glass bread field light road music table water night silver garden mountain letter".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.3 else "") for _ in range(n))
