"""What the classifiers see of a text, against plain statements over its words."""

import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from seqspan.llm import quality, toxicity
from seqspan.llm.common import text_buffers

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PIECES = (
    "you", "You", "YOUR", "idiot", "1d10t", "i.d.i.o.t", "ID-IOT", "stup1d!!", "the", "The", "THE", "aaa", "soooo", "cat's", "rock&roll", "x", "é", "ÉÉ", "straße", "42", "a1",
    "!?", "...", "tu", "vous", "w@rm", "vermin", "contaminated", "contamination", "$$$", "end!", "#tag", "aa", "a", "日本", "no gap", " ",
)


def texts_of(seed, n=80):
    rng = np.random.default_rng(seed)
    gaps = (" ", "  ", "\n", "\t", "\r\n")
    some = ["".join(str(rng.choice(PIECES)) + str(rng.choice(gaps)) for _ in range(rng.integers(0, 40))) for _ in range(n)]
    return ["", " ", "a", "aa", "!", "end!", "a!", *[s if k % 3 else s.rstrip() for k, s in enumerate(some)], "aa", "a", "you", "idiot"]


def is_upper(c):
    return 65 <= c <= 90


def is_alpha(c):
    return is_upper(c) or 97 <= c <= 122 or c >= 128


def core(word):
    swap = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas", strict=True)}
    return bytes(c for c in (swap.get(c, c) for c in word.lower()) if 97 <= c <= 122 or c >= 128)


def plain_row(text, lexicon):
    """``lexicon``: log odds of cores, of their first 6 and of their first 9 bytes."""
    raw = text.encode()
    words = WORD.findall(raw)
    n, chars = max(1, len(words)), max(1, len(raw))
    cores = [core(w) for w in words]
    seed = [c.decode(errors="replace") in toxicity.INSULTS for c in cores]
    you = [c.decode(errors="replace") in toxicity.SECOND_PERSON for c in cores]
    keys = [cores, [c[:6] if len(c) >= 6 else None for c in cores], [c[:9] if len(c) >= 9 else None for c in cores]]
    learned = [[lex.get(k, 0.0) for k in ks] for lex, ks in zip(lexicon, keys, strict=True)]
    hit = [s or w > 0 for s, w in zip(seed, learned[0], strict=True)]
    near = [any(you[max(0, k - 5) : k + 6]) for k in range(len(words))]
    alpha = sum(map(is_alpha, raw))
    letters = [[c for c in w if is_alpha(c)] for w in words]
    odd = [any(is_alpha(w[k - 1]) and not is_alpha(w[k]) and is_alpha(w[k + 1]) for k in range(1, len(w) - 1)) for w in words]
    return [
        sum(seed) / n, sum(learned[0]) / n, math.log1p(sum(x > 0 for x in learned[0])), sum(learned[1]) / n, sum(learned[2]) / n,
        math.log1p(sum(x > 0 for x in learned[2])), math.log1p(sum(seed)), sum(h and k for h, k in zip(hit, near, strict=True)) / n, sum(you) / n,
        sum(map(is_upper, raw)) / max(1, alpha), sum(len(x) >= 2 and all(map(is_upper, x)) for x in letters) / n, raw.count(b"!") / chars, raw.count(b"?") / chars,
        (chars - sum(is_alpha(c) or 48 <= c <= 57 or c <= 32 for c in raw)) / chars, sum(odd) / n,
        sum(raw[k] == raw[k - 1] == raw[k - 2] and is_alpha(raw[k]) for k in range(2, len(raw))) / chars, math.log1p(len(words)),
    ]


def plain_lexicon(texts, y, least_docs, least_odds):
    out = []
    for cut in (None, 6, 9):
        docs = [{c if cut is None else c[:cut] for c in map(core, WORD.findall(t.encode())) if c and (cut is None or len(c) >= cut)} for t in texts]
        many = [sum(1 for v in y if v == k) for k in (0, 1)]
        lex = {}
        for key in set().union(*docs):
            with_key = [sum(key in d for d, v in zip(docs, y, strict=True) if v == k) for k in (0, 1)]
            odds = math.log((with_key[1] + 0.5) / (many[1] + 1)) - math.log((with_key[0] + 0.5) / (many[0] + 1))
            if with_key[1] >= least_docs and odds >= least_odds:
                lex[key] = odds
        out.append(lex)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_features_match_a_plain_reading(seed):
    texts = texts_of(seed)
    y = np.array([int("cont" in t or "1d10t" in t) for t in texts])
    learned = toxicity.learn_lexicon(pa.array(texts), y, least_docs=2, least_odds=0.2)
    lexicon = plain_lexicon(texts, y, 2, 0.2)
    assert [len(h) for h, _ in learned] == [len(x) for x in lexicon] and all(lexicon)
    for (_, odds), want in zip(learned, lexicon, strict=True):
        np.testing.assert_allclose(sorted(odds), sorted(want.values()))
    want = np.array([plain_row(t, lexicon) for t in texts])
    np.testing.assert_allclose(toxicity.features(*text_buffers(pa.array(texts)), learned), want, rtol=1e-9, atol=1e-12)
    assert (want.max(0) > 0).all()


def test_toxicity_features_do_not_look_at_other_texts():
    texts = texts_of(3)
    none = [(np.zeros(0, np.uint64), np.zeros(0))] * 3
    whole = toxicity.features(*text_buffers(pa.array(texts)), none)
    alone = np.concatenate([toxicity.features(*text_buffers(pa.array([t])), none) for t in texts])
    np.testing.assert_array_equal(whole, alone)


def shape(word):
    kinds = [97 if 97 <= c <= 122 or c >= 128 else 65 if is_upper(c) else 48 if 48 <= c <= 57 else c for c in word]
    return bytes(k for k, _ in groupby(kinds))


def test_quality_features_match_plain_grams():
    """A plain gram has one number, and no two have the same."""
    texts = texts_of(4, 40)
    idx, counts, _ = quality.gram_features(*text_buffers(pa.array(texts)))
    numbers, at = {}, 0
    for t, n in zip(texts, counts, strict=True):
        words = [w.lower() for w in WORD.findall(t.encode())]
        shapes = [shape(w) for w in WORD.findall(t.encode())]
        assert len(words) == n
        again = [(k >= 1 and words[k] == words[k - 1], k >= 2 and words[k] == words[k - 2]) for k in range(n)]
        for k in range(n):
            before = lambda x: x[k - 1] if k else None  # noqa: B023, E731
            grams = [(words[k],), (before(words), words[k]), (shapes[k],), (before(shapes), shapes[k]), (again[k],), (before(again), again[k])]
            for family, gram in enumerate(grams):
                assert numbers.setdefault((family, gram), idx[family, at]) == idx[family, at]
            at += 1
    assert at == idx.shape[1] and len(set(numbers.values())) >= len(numbers) - 8  # 2^18 numbers
