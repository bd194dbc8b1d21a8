"""Words as symbols of an automaton."""

from __future__ import annotations

import pytest

from docsieve.llm import substring as S


def test_codes_are_apart_and_only_whole_words_match():
    coder = S.Coder(3)
    codes = [coder[f"w{i}"] for i in range(8_000)]
    assert len(set(codes)) == 8_000 and {len(c) for c in codes} == {3} and coder["w5"] == codes[5] and coder.number(0) not in codes
    owners = {coder.encode("w1 w2 w3"): 1, coder.encode("w2 w3 w90"): 2}
    rows = [(5, 9, 10, coder.encode("w7 w1 w2 w3 w90 w1 w2 w3")), (1, 9, 0, coder.encode("w1 w2 w3"))]
    found = S.locate(3, 3, owners, rows)
    assert found.values.tolist() == [[5, 9, 11, 18]]


def test_places_grow_with_the_words(monkeypatch):
    monkeypatch.setattr(S, "BASE", 4)
    monkeypatch.setattr(S, "PLACES", 2)
    used = []

    def run(coder):
        used.append(coder.places)
        return [coder[str(i)] for i in range(100)]

    assert len(set(S.with_places(run))) == 100 and used == [2, 3, 4]
    with pytest.raises(OverflowError):
        S.Coder(1).number(4)
