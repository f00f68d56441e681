"""Word scores under the piece probabilities of a corpus much larger than the tables."""

import numpy as np
import public_tokenizers

from kinlight.llm import language_id


def test_scores_stay_finite_in_a_large_corpus():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language_id.load_vocabulary(path).get_piece_size()
    # a piece never seen in 7e8, and half of that in the second language
    probability = np.full((pieces, 2), 0.05 / 7e8) * [1.0, 2.0]
    scores = language_id.WordScores(path, language_id.PieceModel(["a", "b"], np.log([0.5, 0.5]), probability))
    long = "的一是不" * 8
    totals = scores.of_texts([[long], ["word"], [long, "word"]])
    assert np.isfinite(totals).all() and (totals[:, 1] > totals[:, 0]).all()
    assert np.allclose(totals[2], totals[0] + totals[1])


def test_logs_give_what_products_give():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language_id.load_vocabulary(path).get_piece_size()
    probability = np.random.default_rng(1).dirichlet(np.ones(pieces), 3).T
    scores = language_id.WordScores(path, language_id.PieceModel(["a", "b", "c"], np.zeros(3), probability))
    words = ["word", "unwahrscheinlich", "的一ሴ", "été"]
    assert np.allclose(scores._forward(words), [scores._forward_logs(w) for w in words])
