"""What one task holds stays bounded, whatever the size of a part or of an anchor's group."""

import random

import corpus_pipeline
import numpy as np
from crawlens.llm import similar, simhash, suffixes
from crawlens.llm.blocks import _joined, blocks, exchange, packed


def test_a_block_carries_its_own_answers_only(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(40)], "doc_id long, text string").repartition(2)
    made = blocks(docs, block_bytes=100)
    exchange(made, "said", lambda block: iter([(0, f"{block.part}.{block.number}".encode()), (1, b"x")]), lambda sent: [None if x == b"x" else x for x in sent])
    rows = _joined(made).collect()
    assert len(rows) > 10 and all([(x["grp"], bytes(x["data"]).decode()) for x in r["re_said"]] == [(0, f"{r['part']}.{r['number']}")] for r in rows)


def test_heavy_anchors_go_string_by_string(spark, monkeypatch):
    several = lambda size: packed(np.array([7], np.uint64), np.array([int(4 * np.log2(size)) << 1 | 1], np.int64))
    assert [x[0] for x in suffixes._told([several(suffixes.HEAVY // 4)] * 2)] == [suffixes.OTHERS] * 2
    assert [x[0] for x in suffixes._told([several(suffixes.HEAVY // 4)] * 5)] == [suffixes.CROWD] * 5
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    line = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(20)) + line + " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(30)]
    docs = spark.createDataFrame([*rows, (30, rows[0][1]), (31, None)], "doc_id long, text string").repartition(3)
    got = lambda: sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.removed(docs).collect())
    gathered = got()
    monkeypatch.setattr(suffixes, "HEAVY", 1)
    assert got() == gathered and sum(r[1] for r in gathered) >= 30 * len(line) - 100


def test_stage_links_by_simhash_first(spark, monkeypatch):
    """The stage's classes come through SimHash: without its exact search it still drops copies and what differs in two bits, and nothing below the bound."""
    asked, before = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, d=2, dense=simhash.DENSE: asked.append(d) or before(fps, d, dense))
    monkeypatch.setattr(similar, "_links", lambda shared, sets, near: near)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(1500)) for _ in range(12)]
    texts += [t + f" and so on {i}" for i, t in enumerate(texts[:8])] + [texts[0].upper()]
    far = [bin(simhash.fingerprint(texts[i].encode(), 5) ^ simhash.fingerprint(texts[12 + i].encode(), 5)).count("1") for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert asked == [similar.BITS] and any(0 < n <= 2 for n in far)
    assert got == set(range(12)) | {12 + i for i, n in enumerate(far) if n > 2}


def test_a_worker_hashes_its_blocks_with_one_table_and_finds_the_earliest_without_a_sort(monkeypatch):
    from types import SimpleNamespace

    from crawlens.llm import suffixes

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (400, 99, 0, 100, 2_000, 101)]
    suffixes._POWERS.clear()
    alone = suffixes.Runs(SimpleNamespace(texts=texts[3:]))
    whole = suffixes.Runs(SimpleNamespace(texts=texts))
    again = suffixes.Runs(SimpleNamespace(texts=texts[3:]))
    assert len(suffixes._POWERS[0]) == sum(map(len, texts)) and whole.up.base is again.up.base
    assert alone.keys.tolist() == again.keys.tolist() == whole.keys[-len(alone.keys) :].tolist()
    held = sum((whole.hi - whole.lo + 1).tolist())
    assert held == sum(max(0, len(t) - suffixes.LENGTH + 1) for t in texts)
    for ids in (50, 2):  # rows with ids of their own, and rows that repeat one
        doc, place, cls = rng.integers(0, ids, 300), rng.integers(0, 9, 300), rng.integers(0, 20, 300)
        if ids == 50:
            by = np.lexsort((place, doc))
            doc, place = doc[by], place[by]
            monkeypatch.setattr(suffixes.np, "lexsort", None)
        first = suffixes._earliest_of(cls, doc, place)
        monkeypatch.undo()
        for c in set(cls.tolist()):
            assert (doc[first[c]], place[first[c]]) == min((d, p) for d, p, k in zip(doc.tolist(), place.tolist(), cls.tolist()) if k == c)


def test_encoding_a_batch_takes_little_memory():
    import random
    import tracemalloc

    import numpy as np

    from crawlens.llm import pieces

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghinorst", k=rng.randint(2, 9))) for _ in range(400)).encode() for _ in range(512)]
    with open(pieces.MODEL, "rb") as f:
        own = pieces.tables(f.read())
    docs = pieces.Pieces(own)
    groups, size = [[]], 0
    for t in texts:
        groups[-1].append(t)
        if (size := size + len(t)) >= pieces.GROUP:
            groups, size = [*groups, []], 0
    tracemalloc.start()
    for g in groups:
        docs.encode_many(g, np.arange(len(g)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75e6, peak
