from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n))
