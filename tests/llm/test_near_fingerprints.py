"""The pipeline's near-dedup has operator 4's links, also where no band of MinHash is shared."""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from docsieve.llm import neardocs, simhash

#: Each without its last two words has 8 of 10 shingles and a fingerprint two bits apart, and shares no band with it.
UNBANDED = ["ren nil rol nom mel nod vib dub mop mor vik nen bat duk", "ron kur dis map ran ses big nad kan vuk dep let dug luk"]


def test_pairs_that_no_band_finds(spark, sf):
    rows = []
    for i, whole in enumerate(UNBANDED):
        part = whole.rsplit(" ", 2)[0]
        p, q = neardocs.shingle_sets(pa.array([whole, part]))
        assert neardocs.near(p, q) and not (neardocs.band_values(p) == neardocs.band_values(q)).any()
        a, b = (simhash.fingerprint(t.encode(), neardocs.WIDTH, once=True) for t in (whole, part))
        assert (a ^ b).bit_count() == 2
        rows += [(2 * i, whole, "x"), (2 * i + 1, part, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, sf).collect()) == [0, 2]


def test_linked_fingerprints_are_compared_not_believed(spark, sf, monkeypatch):
    """Texts of one fingerprint and no common shingle stay."""
    monkeypatch.setattr(neardocs.simhash, "text_fingerprints", lambda column, *_, **__: pa.array([0] * len(column), pa.int64()))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(9)] + [(9, " ".join(f"w3x{j}" for j in range(10)))]
    got = neardocs.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(9))


@pytest.mark.parametrize(("parts", "frequent"), [(2, 24), (3, 24), (2, 0), (3, 0)])
def test_values_hold_linked_pairs_and_no_others(spark, parts, frequent):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for b in [*fps]:
        for _ in range(3):
            x = b
            for bit in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << bit
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    met = defaultdict(set)
    for r in simhash.alike(spark.createDataFrame([(x,) for x in signed], "fp long"), parts, frequent).collect():
        met[r.value].add(r.fp)
    got = {(a, b) for m in met.values() for a in m for b in m if a > b}
    assert got == {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
