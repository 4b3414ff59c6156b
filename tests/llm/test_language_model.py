"""The language model's fast paths against plain ones: words encoded in one call, attention, shares of the model."""

import math

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import lm_score
from granary.llm.common import Words, string_bytes

TEXTS = ["a rose is a rose", None, "", "é ü ﬀ 😀x  y\tz\nq r", "a\x00b \x1c x", "İ ß " * 5, "x" * 3000, "\n\n", "   y \r\n0123456789012345 ...!? it's"]


def test_words_are_encoded_in_one_call():
    """The ids of a slice's new words come from one call, and equal those of each word by itself."""
    import tiktoken

    with open(lm_score.VOCABULARY_FILE, "rb") as f:
        ranks = f.read()
    table = {lm_score.base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary
    words = Words(*string_bytes(pa.array(TEXTS, pa.string())))
    subwords, calls = lm_score.Subwords(ranks), []
    encode = subwords.encode
    subwords.encode = lambda t: calls.append(1) or encode(t)
    ids, begin = subwords.sequences(words, words.hashes())
    assert len(calls) == 1
    for k in range(len(TEXTS)):
        own = [words.text(i).decode() for i in range(words.first[k], words.first[k + 1])]
        assert ids[begin[k] : begin[k + 1]].tolist() == [lm_score.END, *(i for w in own for i in plain(" " + w)), lm_score.END]


@pytest.mark.parametrize("grown", [1, 40])
def test_attention_against_plain(grown):
    """Probabilities equal those of a plain softmax in doubles, also where exponents are tall."""
    rng = np.random.default_rng(5)
    model = lm_score.Attention({k: x * grown for k, x in lm_score.Attention.fresh(4).weights.items()})
    w = {k: x.astype(np.float64) for k, x in model.weights.items()}
    x, target = rng.integers(0, lm_score.CLASSES, (2, 3, lm_score.SEEN))
    h = w["e"][x] + w["p"]
    q, k, v = np.split(h @ w["qkv"], 3, -1)
    a = np.where(np.tril(np.ones((lm_score.SEEN, lm_score.SEEN), bool)), q @ k.transpose(0, 2, 1) / math.sqrt(lm_score.WIDTH), -np.inf)
    a = np.exp(a - a.max(-1, keepdims=True))
    out = (h + a / a.sum(-1, keepdims=True) @ v) @ w["u"] + w["b"]
    logs = out - out.max(-1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(-1, keepdims=True))
    want = np.take_along_axis(logs, target[..., None], -1)[..., 0]
    exact = lm_score.Attention(w)
    got = exact.chances(x, 0, target).reshape(target.shape)
    assert np.allclose(got, np.exp(want), rtol=1e-6, atol=1e-12)
    assert np.allclose(exact.slopes(x, target, np.ones(x.size))[0], np.exp(want), rtol=1e-6, atol=1e-12)
    single = model.chances(x, 0, target)
    assert np.isfinite(single).all() and (grown > 1 or np.allclose(single.reshape(target.shape), np.exp(want), rtol=1e-4))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 333])
def test_shares_against_plain_logs(n):
    p, q = np.random.default_rng(n).random((2, n)) * 1e-6
    want = np.log(lm_score.MIXES[:, None] * p + (1 - lm_score.MIXES[:, None]) * q).sum(1)
    assert np.allclose(lm_score.mixed_logs(p.astype(np.float32), q.astype(np.float32)), want, rtol=1e-5)
