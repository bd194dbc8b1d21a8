"""Languages by contract: und for letterless texts alone, any number of languages, the best path of all."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from docsieve.llm import langid


def learned(spark, extra=()):
    rng = random.Random(4)
    make = {"xx": "abcd", "yy": "wxyz", "ru": "абвг"}
    word = lambda k: "".join(rng.choice(make[k]) for _ in range(5))
    rows = [(i, " ".join(word(k) for _ in range(30)), k) for i, k in enumerate(list(make) * 20)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def test_only_texts_without_letters_are_undetermined(spark):
    odd = ["ひらがな", "தமிழ்", "😀😀", "12 !", "", None, "𐐷𐐷𐐷", "abab"]
    df = learned(spark, [(1000 + i, t, None) for i, t in enumerate(odd)])
    got = {r.doc_id - 1000: (r.lang_pred, r.score) for r in langid.languages(df).filter("doc_id >= 1000").collect()}
    assert {i for i, (x, _) in got.items() if x == "und"} == {2, 3, 4, 5}
    assert got[0] == got[1] == got[6] == ("ru", 0.0) and got[7][0] == "xx"
    kept = {r.doc_id - 1000 for r in langid.with_language(df).filter("doc_id >= 1000").collect()}
    assert kept == {0, 1, 6, 7}


def test_scripts_are_those_of_the_letters():
    import pyarrow as pa

    words = {"ਪੰਜਾਬੀ": "GURMUKHI", "தமிழ்": "TAMIL", "සිංහල": "SINHALA", "ລາວ": "LAO", "አማርኛ": "ETHIOPIC", "монгол": "CYRILLIC", "漢字": "CJK", "한국어": "HANGUL", "plain": "LATIN", "ελληνικά": "GREEK"}
    for text, name in words.items():
        assert langid.NAMES[langid.words_of(pa.array([text])).script[0]] == name


def test_more_languages_than_a_byte_counts():
    emit = np.full((1, 3, 300), -1.0, np.float32)
    emit[0, :, 290] = 5
    path, lead = langid.viterbi(emit)
    assert path.tolist() == [[290, 290, 290]] and lead[0] == pytest.approx(18)


@pytest.mark.parametrize("seed", range(20))
def test_the_path_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    steps, k = 5, 3
    emit = rng.normal(0, 6, (1, steps, k)).astype(np.float32)
    score = lambda p: sum(emit[0, t, x] for t, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
    best = max(itertools.product(range(k), repeat=steps), key=score)
    assert score(langid.viterbi(emit)[0][0].tolist()) == pytest.approx(score(best), abs=1e-4)
