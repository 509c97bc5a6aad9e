"""What the driver and a Python worker hold at once."""

import tracemalloc

import numpy as np

from tessera.llm import imatch, piece_bpe, toxicity
from tessera.llm.queries import piece_model_file


def test_a_lexicon_reaches_the_driver_as_numbers(spark, monkeypatch):
    """Not as row objects, of which two million are several hundred MB."""
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 4} c{i % 5}") for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("row objects")))
    assert imatch.fingerprint_documents(docs).count() == 12


def test_new_words_are_merged_in_bounded_parts():
    with open(piece_model_file(), "rb") as f:
        encoder = piece_bpe.Encoder(piece_bpe.PieceModel(f.read()))
    merged, sizes = encoder.model.merged, []
    encoder.model.merged = lambda words: (sizes.append(sum(map(len, words))), merged(words))[1]
    texts = [" ".join(f"w{i:x}" for i in range(k, 150_000, 3)) for k in range(3)]
    flat, bounds = encoder.encode(texts)
    assert max(sizes) <= 300_000 < sum(sizes)
    assert [encoder.model.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == texts


def test_toxicity_holds_the_words_of_few_texts(monkeypatch):
    """A batch of texts has many times as many words as its parts."""
    monkeypatch.setattr(toxicity, "CACHE", 2_000)
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    some = " ".join(f"w{i}" for i in range(3_000))
    whole, context = toxicity._keys(toxicity._windows(some.split())[0])
    ratios = toxicity.Ratios(np.r_[keys, whole[::3]], np.linspace(-3, 3, 1000 + len(whole[::3])), np.r_[keys, context[::2]], np.linspace(2, -2, 1000 + len(context[::2])))
    texts = [" ".join(f"w{i * k % 3_001}" for i in range(2_000)) for k in range(1, 401)] + [""]
    tracemalloc.start()
    try:
        got = ratios.evidence(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25_000_000
    assert got.tolist() == [toxicity.evidence(ratios.of_words(toxicity.words(t))) for t in texts]
    assert ratios.evidence([]).tolist() == []
