"""The composed transducers against a plain reading of each clause."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docsieve.llm import toxicity as X

LEXICON = X.Lexicon({"grumbo": 5.0, "kill": 4.0}, {n: {} for n in X.PREFIXES})
WORDS = ["grumbo", "kill", "you", "not", "said", "plain", '"', ".", "\n", "word"]


def plainly(tokens):
    """What each hit counts for, by looking back over the words before it."""
    sums, clause, done = dict.fromkeys(X.FEATURES, 0.0), 0.0, []
    for i, t in enumerate(tokens):
        if t in (".", "\n"):
            done.append(clause)
            clause = 0.0
        if t not in LEXICON.words:
            continue
        line = max([k for k in range(i) if tokens[k] == "\n"], default=-1)
        begin = max([k for k in range(i) if tokens[k] in (".", "\n")], default=-1)
        quoted = tokens[line + 1 : i].count('"') % 2 == 1
        words = [w for w in tokens[begin + 1 : i] if w != '"']
        near = words[-X.REACH :]
        w = LEXICON.words[t]
        threat = t in X.THREATS
        kind = "negated" if "not" in near else "reported" if quoted or "said" in words else ("threatened" if threat else "addressed") if "you" in near else "threat" if threat else "insult"
        sums[kind] += w
        clause += w * (X.DENIED if kind in ("negated", "reported") else 1)
    done.append(clause)
    return sums | {"most": max(done), "clauses": sum(c > 0 for c in done)}


@pytest.mark.parametrize("seed", range(40))
def test_composition_is_all_machines_at_once(seed):
    rng = random.Random(seed)
    tokens = [rng.choice(WORDS) for _ in range(60)]
    got = np.expm1(X.clause_paths(LEXICON, " ".join(tokens)))
    want = plainly(tokens)
    assert got == pytest.approx([want[k] for k in X.FEATURES])


def test_threats_and_insults_stay_apart_when_addressed():
    f = lambda t: dict(zip(X.FEATURES, np.expm1(X.clause_paths(LEXICON, t)), strict=True))
    assert f("you grumbo")["addressed"] == pytest.approx(5) and f("you kill")["threatened"] == pytest.approx(4)
    assert f("kill")["threat"] == pytest.approx(4) and f("you kill")["addressed"] == 0


def test_a_composed_machine_steps_each_of_its_machines():
    step = X.compose(X.GRAMMAR)
    rng = random.Random(3)
    states = each = tuple(m.start for m in X.GRAMMAR)
    for _ in range(500):
        classes = rng.choice([0, 1, 2, 4, 8, 16, 5, 12, 32, 64, 128])
        states, _ = step(states, classes)
        each = tuple(m.step(s, classes) for m, s in zip(X.GRAMMAR, each, strict=True))
        assert states == each
