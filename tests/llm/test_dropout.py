"""Dropout is drawn at each occurrence, at its rate, and every segmentation is what a plain scan gives."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from crawlens.llm import pieces
from tests.llm.test_operators import corpus, model  # noqa: F401

FULL = (1 << 64) - 1


class Plain:
    """Merge-dropout by a scan for the best candidate, with draws in whole numbers; shares nothing with the operator."""

    def __init__(self, dropout, seed):
        sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
        names = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        self.byte = {int(n[3:5], 16): i for i, n in names if sp.is_byte(i)}
        self.rank = {n: (-sp.get_score(i), i) for i, n in names if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.dropout, self.seed = dropout, seed

    def draws(self, key):
        """True for every candidate that is skipped."""
        turn = 0
        while True:
            h = key ^ ((turn + 1) * 0x8CB92BA72F3D8DD7 & FULL)
            h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & FULL
            h = (h ^ h >> 27) * 0x94D049BB133111EB & FULL
            u = (((h ^ h >> 31) >> 11) + 0.5) / (1 << 53)
            for _ in range(int(np.floor(np.log(u) / np.log1p(-self.dropout))) if 0 < self.dropout < 1 else 0 if self.dropout else 10**6):
                yield False
            yield True
            turn += 1

    def chunk(self, chunk, draw):
        parts, dead = [(c, i) for i, c in enumerate(chunk)], set()
        while True:
            open_ = [(self.rank[a + b], i, a + b, k) for k, ((a, i), (b, _)) in enumerate(zip(parts, parts[1:])) if a + b in self.rank and (i, a, b) not in dead]
            if not open_:
                return [x for s, _ in parts for x in ([self.rank[s][1]] if s in self.rank and s != "\0" else [self.byte[b] for b in s.replace("\0", pieces.MARK).encode()])]
            _, i, joined, k = min(open_)
            if next(draw):
                dead.add((i, parts[k][0], parts[k + 1][0]))
            else:
                parts[k : k + 2] = [(joined, i)]

    def text(self, text, key):
        if not text:
            return []
        marked = pieces.MARK + text.replace(pieces.MARK, "\0").replace(" ", pieces.MARK)  # "\0": a mark that stands in the text itself
        out = []
        for k, c in enumerate(re.findall(f"{pieces.MARK}*[^{pieces.MARK}\n]+|{pieces.MARK}+|\n+", marked)):
            own = ((key * 0x9E3779B97F4A7C15 + self.seed & FULL) + k) * 0xD6E8FEB86659FD93 & FULL
            out += self.chunk(c, self.draws(own))
        return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_segmentations_equal_a_plain_scan(model, dropout):  # noqa: F811
    """Whole texts, also with chunks that come once, often, in copies, and longer than any width."""
    rng = random.Random(7)
    texts = [t for _, t, *_ in corpus() if t is not None and len(t) < 3000] * 2
    texts += ["the national segmentation of ordinary words " * 8, "x" * 150 + "national" * 4 + " end", "  two\n\n blanks \n", "ab\n\ncd ", " ", "\n", "".join(rng.choice("abcdefgh ▁é漢😀\n") for _ in range(400))]
    keys = [rng.randrange(1 << 63) for _ in texts]
    p, plain = pieces.Pieces(model, dropout, 5), Plain(dropout, 5)
    ids, counts, same = p.encode_many([t.encode() for t in texts], np.array(keys, np.int64))
    assert same.all()
    for own, t, k in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, keys):
        assert own.tolist() == plain.text(t, k)


def test_memo_changes_nothing(model, monkeypatch):  # noqa: F811
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "ordinary", "segmentation", "of", "national", "words", "kilumenor"]) for _ in range(60)).encode() for _ in range(200)]
    keys = np.arange(200)
    p = pieces.Pieces(model)
    first = p.encode_many(texts, keys)[0].tolist()
    assert p.encode_many(texts, keys)[0].tolist() == first
    monkeypatch.setattr(pieces, "MEMO", 0)
    assert sum((p.encode_many([t], keys[i : i + 1])[0].tolist() for i, t in enumerate(texts)), []) == first


@pytest.mark.parametrize("word", ["the", "ordinary", "segmentation", "x" * 20 + "national" * 3])
def test_each_occurrence_draws(model, word):  # noqa: F811
    """Rates of segmentations against fresh draws, over documents and within one."""
    p, n, chunk = pieces.Pieces(model), 2000, pieces.MARK + word
    ids, counts, _ = p.encode_many([word.encode()] * n, np.arange(n))
    got = Counter(map(tuple, np.split(ids, np.cumsum(counts)[:-1])))
    rng, plain = random.Random(1), Plain(p.dropout, p.seed)

    def fresh():
        while True:
            yield rng.random() < p.dropout

    draw = fresh()
    want = Counter(tuple(plain.chunk(chunk, draw)) for _ in range(n))
    assert len(got) > 4
    for ids in {x for x, _ in want.most_common(5)} | {x for x, _ in got.most_common(5)}:
        assert abs(got[ids] - want[ids]) <= 5 * math.sqrt(got[ids] + want[ids])
    inside = {tuple(p.encode(" ".join([word] * 200), k)) for k in range(20)}
    assert len(inside) == 20


def test_megabytes(model):  # noqa: F811
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(1, 12))) for _ in range(300_000)), "x" * 300_000, "漢字" * 60_000]
    p = pieces.Pieces(model)
    for t in texts:
        ids, _, same = p.encode_many([t.encode()], np.array([4]))
        assert same.all() and p.decode(ids) == t


def test_too_large_a_model_fails(spark, docs, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_MODEL", 1000)
    for fn in (lambda: pieces.encoded(docs), lambda: pieces.decoded(docs.selectExpr("doc_id", "array(1) AS ids"))):
        with pytest.raises(ValueError):
            fn()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a")], "doc_id long, text string")
