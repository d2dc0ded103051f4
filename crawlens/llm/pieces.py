"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text gets the dummy blank in front and blanks become the piece mark; since no piece has a mark after another
character, the text falls into chunks (marks, then characters up to the next mark or line end) that merge on their own.
A chunk is segmented from an agenda: adjacent symbols whose join is a piece wait in the order of the piece's score, then
of place. Each candidate that is taken from the agenda is skipped with probability ``dropout``, else it merges and its new
neighbours become candidates. Every occurrence draws for itself: the numbers of candidates between its skips are geometric,
from a keyed hash of (document's key, chunk's number in the document, seed).

All chunks of some hundred KB of text are worked out side by side as array operations. A segmentation depends on the chunk and on
which of its candidates were skipped, so that a state (chunk, up to DEPTH skips) that occurs again comes from a memo: states form a
tree whose edges are the skipped candidates, and an occurrence walks down until its next skip lies beyond the state's last
candidate. Occurrences with more skips, chunks of more than LONG characters and chunks seen once run their own agenda with
their own draws, which gives the same ids. The memo holds at most MEMO states and SYMBOLS ids and is emptied beyond that,
which changes no result. With dropout 0 the result is the model's own encoding.

Characters without a piece become byte pieces, and so does a piece mark that stands in the text itself; decoding joins
bytes, so every text comes back unchanged whatever was skipped. The model is never trained here; its file is a
parameter, bounded by MAX_MODEL, and its tables travel to the executors as a broadcast.

Defined cases: a null text gives null ids and a null text, an empty one none; equal texts under different ids are cut
differently, repeated rows alike; long texts and words are handled in log-linear time; empty tables give
empty results; other columns are not looked at; ``dropout`` 1 leaves single characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL = 64 << 20
DROPOUT, SEED = 0.1, 1
MEMO, SYMBOLS, DEPTH, LONG = 250_000, 2_000_000, 3, 32
MARK = "▁"
FULL, VARY = (1 << 64) - 1, 0x8CB92BA72F3D8DD7
WIDTHS, NONE, NEVER = (4, 6, 8, 12, 16, 24, 32, 64, 128), (1 << 31) - 1, 1 << 40
PLACE = 7  # bits of a place within a chunk
SLOTS = 20  # bits of the table of joins
DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "lossless"]
GROUP = 400_000  # bytes of text that are encoded together


class Rows:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(need, 2 * len(self.data)) - len(self.data), self.data.dtype)))
        self.data[self.n : need] = values
        self.n = need


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def tables(model: bytes) -> dict:
    """What encoding and decoding need of a model, as arrays. A symbol is a piece's id, or ``other`` plus the code of a character without one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    other = sp.get_piece_size()
    rank: dict[str, tuple[float, int]] = {}
    raw: list[bytes] = []
    byte_id = np.zeros(256, np.int32)
    for i, name in enumerate(sp.id_to_piece(list(range(other)))):
        if sp.is_byte(i):
            byte_id[int(name[3:5], 16)] = i
            raw.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            rank[name] = (-sp.get_score(i), i)
            raw.append(name.replace(MARK, " ").encode())
    order = sorted(rank, key=rank.get)
    ids = {x: r[1] for x, r in rank.items()}
    symbol = ids | {x: other + ord(x) for name in order for x in name if x not in ids}
    singles = {32 if x == MARK else ord(x): i for x, i in ids.items() if len(x) == 1}
    joins = [(symbol[x[:i]] << 21 | symbol[x[i:]], at) for at, x in enumerate(order) for i in range(1, len(x)) if x[:i] in symbol and x[i:] in symbol]
    keys, orders = zip(*joins) if joins else ((), ())
    return {
        "other": other, "byte_id": byte_id, "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_sizes": np.fromiter(map(len, raw), np.int64, other),
        "codes": np.array(list(singles.items()), np.int64).reshape(-1, 2), "piece_of": np.array([ids[x] for x in order], np.int32),
        "keys": np.array(keys, np.int64), "orders": np.array(orders, np.int32),
    }


class Pieces:
    """A model's pieces, scores and bytes (the model itself or its tables), with encoding and decoding."""

    def __init__(self, model: bytes | dict, dropout: float = DROPOUT, seed: int = SEED):
        t = model if isinstance(model, dict) else tables(model)
        self.byte_id, self.other, self.piece_of = t["byte_id"], t["other"], t["piece_of"]
        self.raw, self.raw_sizes = t["raw"], t["raw_sizes"]
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.of_code = np.arange(self.other, self.other + 0x110000, dtype=np.int32)
        self.of_code[t["codes"][:, 0]] = t["codes"][:, 1]
        self._hash(t["keys"], t["orders"])
        self.dropout, self.seed = dropout, seed
        self.clear()

    def _hash(self, keys: np.ndarray, orders: np.ndarray) -> None:
        """The joins in an open table; ``probes`` is the longest walk."""
        self.join_of: dict[int, int] | None = None
        self.slot_keys, self.slot_orders, self.probes = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int32), 1
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_keys[at[left]] < 0
            self.slot_keys[at[left[free]]] = keys[left[free]]
            won = self.slot_keys[at[left]] == keys[left]
            self.slot_orders[at[left[won]]] = orders[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)
            self.probes += len(left) > 0

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The order of the piece that two symbols make together; NONE if there is none. Symbols below zero make none."""
        keys = (left.astype(np.int64) << 21) | right
        at = self.slot(keys)
        found = self.slot_keys[at]
        out = np.where(found == keys, self.slot_orders[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << SLOTS) - 1)
            found = self.slot_keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_orders[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def clear(self) -> None:
        """Empty the memo; ``first`` has the state of each chunk without skips."""
        self.chunks: dict[bytes, int] = {}
        self.text, self.text_at, self.text_n, self.first = Rows(np.int32), Rows(np.int64), Rows(np.int32), Rows(np.int32)
        self.chunk, self.depth, self.taken = Rows(np.int32), Rows(np.int8), Rows(np.int32)
        self.skipped = [Rows(np.int32) for _ in range(DEPTH)]
        self.ids, self.at, self.n = Rows(np.int32), Rows(np.int64), Rows(np.int32)
        self.child, self.child_at = Rows(np.int32), Rows(np.int64)

    def gaps(self, keys: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
        """How many candidates merge before the next one is skipped; ``turn`` skips came before."""
        if not self.dropout:
            return np.full(len(keys), NEVER)
        h = keys ^ (np.atleast_1d(turn).astype(np.uint64) + np.uint64(1)) * np.uint64(VARY)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        with np.errstate(divide="ignore"):
            return np.floor(np.log(u) / np.log1p(-self.dropout)).astype(np.int64)

    def skips(self, key: int) -> Iterator[int]:
        """The numbers of the skipped candidates of one occurrence, without end."""
        at = -1
        for first in range(0, 1 << 60, 256):
            for g in self.gaps(np.full(256, key, np.uint64), np.arange(first, first + 256)).tolist():
                at += 1 + g
                yield at

    def cut(self, symbols: list[int], skips: Iterator[int]) -> list[int]:
        """The symbols of one chunk of any length, after its merges."""
        n, taken, skip = len(symbols), 0, next(skips)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        s, piece_of = list(symbols), self.piece_of

        if self.join_of is None:
            self.join_of = dict(zip(self.slot_keys[self.slot_keys >= 0].tolist(), self.slot_orders[self.slot_keys >= 0].tolist()))
        order = self.join_of.get
        agenda = [(o, i, s[i], s[i + 1]) for i in range(n - 1) if (o := order(s[i] << 21 | s[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            o, i, a, b = heappop(agenda)
            j = right[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # a neighbour has merged since
            taken += 1
            if taken - 1 == skip:
                skip = next(skips)
                continue
            s[i], s[j] = int(piece_of[o]), -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (o := order(s[i] << 21 | s[k])) is not None:
                    heappush(agenda, (o, i, s[i], s[k]))
            if (h := left[i]) >= 0 and (o := order(s[h] << 21 | s[i])) is not None:
                heappush(agenda, (o, h, s[h], s[i]))
        return [x for x in s if x >= 0]

    def agendas(self, s: np.ndarray, skip: np.ndarray, more: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One agenda per column of symbols, a candidate of each at a time; merged-away places become -1. Also the numbers of candidates.

        ``skip`` has each column's first skipped candidate, ``more(columns, turns, last)`` the next ones.
        """
        s = np.ascontiguousarray(s, np.int32)
        width, n = s.shape
        whole, counts = np.empty((width, n), np.int32), np.zeros(n, np.int32)
        waiting = np.full((width, n), NONE, np.int32)  # by left place: order of the candidate, then the place
        here = np.arange(width, dtype=np.int32)[:, None]
        found = self.joins(s[:-1].ravel(), s[1:].ravel()).reshape(width - 1, n)
        waiting[:-1] = np.where(found < NONE, (found << PLACE) | here[:-1], NONE)
        after = np.repeat(np.arange(1, width + 1, dtype=np.int16)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, width - 1, dtype=np.int16)[:, None], n, axis=1)
        after[:-1][s[1:] < 0] = width
        of, taken, turn, skip = np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), skip.copy()
        while True:
            least = waiting.min(axis=0)
            live = np.flatnonzero(least < NONE)
            if 4 * len(live) <= 3 * len(of):
                over = np.flatnonzero(least == NONE)
                whole[:, of[over]], counts[of[over]] = s[:, over], taken[over]
                if not len(live):
                    return whole, counts
                s, waiting, after, before = (x.take(live, axis=1) for x in (s, waiting, after, before))
                of, taken, turn, skip, least = of[live], taken[live], turn[live], skip[live], least[live]
                live = np.arange(len(of))
            m = len(of)
            flat, wait, nxt, prv = s.reshape(-1), waiting.reshape(-1), after.reshape(-1), before.reshape(-1)
            low = least[live]
            i, piece = (low & ((1 << PLACE) - 1)).astype(np.int64), self.piece_of[low >> PLACE]
            out = np.flatnonzero(taken[live] == skip[live])
            taken[live] += 1
            if len(out):
                c = live[out]
                wait[i[out] * m + c] = NONE
                turn[c] += 1
                skip[c] = more(of[c], turn[c], skip[c])
                stay = np.ones(len(live), bool)
                stay[out] = False
                live, i, piece = live[stay], i[stay], piece[stay]
            at = i * m + live
            j = nxt[at].astype(np.int64) * m + live
            k = nxt[j].astype(np.int64)
            flat[at], flat[j], wait[j], nxt[at] = piece, -1, NONE, k
            has = np.flatnonzero(k < width)
            wait[at] = NONE
            if len(has):
                right = k[has] * m + live[has]
                prv[right] = i[has]
                o = self.joins(piece[has], flat[right])
                wait[at[has]] = np.where(o < NONE, (o << PLACE) | i[has].astype(np.int32), NONE)
            h = prv[at].astype(np.int64)
            has = np.flatnonzero(h >= 0)
            if len(has):
                back = h[has] * m + live[has]
                o = self.joins(flat[back], piece[has])
                wait[back] = np.where(o < NONE, (o << PLACE) | h[has].astype(np.int32), NONE)

    def worked(self, at: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, skip: np.ndarray, more: Callable, longest: Callable[[int], Iterator[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks given by place and size in ``symbols`` → (all ids in order, how many each has, numbers of candidates)."""
        n = len(at)
        sizes = np.asarray(sizes, np.int64)
        counts, taken = np.zeros(n, np.int64), np.zeros(n, np.int32)
        rows_of, parts = [], []
        for low, width in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(rows):
                continue
            places = np.arange(width)[:, None]
            s = np.where(places < sizes[rows], symbols[np.minimum(at[rows] + places, len(symbols) - 1)], -1)
            done, taken[rows] = self.agendas(s, skip[rows], lambda c, t, last, rows=rows: more(rows[c], t, last))
            done = done.T
            left = done >= 0
            counts[rows] = left.sum(axis=1)
            rows_of.append(rows)
            parts.append(done[left])
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            own = self.cut(symbols[at[i] : at[i] + sizes[i]].tolist(), longest(i))
            counts[i] = len(own)
            rows_of.append(np.array([i]))
            parts.append(np.array(own, np.int32))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if n else 0, np.int32)
        for rows, part in zip(rows_of, parts):
            out[spread(ends[rows] - counts[rows], counts[rows])] = part
        return *self.to_bytes(out, counts), taken

    def to_bytes(self, out: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become byte pieces."""
        odd = np.flatnonzero(out >= self.other)
        if not len(odd):
            return out, counts
        codes = (out[odd] - self.other).astype(np.uint32)
        raw = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        wide = np.ones(len(out), np.int64)
        wide[odd] = sizes
        where = np.cumsum(wide) - wide
        longer = np.empty(int(wide.sum()), np.int32)
        longer[where] = out
        longer[spread(where[odd], sizes)] = self.byte_id[raw]
        owner = np.repeat(np.arange(len(counts)), counts)
        return longer, np.bincount(owner, wide, len(counts)).astype(np.int64)

    def states(self, chunk: np.ndarray, skipped: list[np.ndarray], depth: int) -> np.ndarray:
        """New states of the memo: the numbers of chunks, each with ``depth`` skips."""
        new = np.arange(self.chunk.n, self.chunk.n + len(chunk))
        table = np.array([*skipped, *[np.full(len(chunk), NEVER)] * (DEPTH + 1 - depth)], np.int64)
        ids, counts, taken = self.worked(
            self.text_at.data[chunk], self.text_n.data[chunk], self.text.data[: self.text.n], table[0], lambda c, t, last: table[t, c], lambda i: iter(())
        )
        self.chunk.add(chunk)
        self.depth.add(np.full(len(chunk), depth))
        self.taken.add(taken)
        for d in range(DEPTH):
            self.skipped[d].add(np.minimum(table[d], NONE))
        self.at.add(np.cumsum(counts) - counts + self.ids.n)
        self.n.add(counts)
        self.ids.add(ids)
        self.child_at.add(np.cumsum(taken, dtype=np.int64) - taken + self.child.n)
        self.child.add(np.full(int(taken.sum()), -1))
        return new

    def below(self, state: np.ndarray, skip: np.ndarray, depth: int) -> np.ndarray:
        """The states that also skip the given candidates."""
        at = self.child_at.data[state] + skip
        to = self.child.data[at]
        missing = np.flatnonzero(to < 0)
        if len(missing):
            places, first, back = np.unique(at[missing], return_index=True, return_inverse=True)
            own = missing[first]
            parent = state[own]
            new = self.states(self.chunk.data[parent], [*(self.skipped[d].data[parent] for d in range(depth - 1)), skip[own]], depth)
            self.child.data[places] = new
            to[missing] = new[back]
        return to

    def encode_many(self, texts: list[bytes | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Several texts, each with its key → (all ids in order, how many each has, whether they decode to the text)."""
        if self.chunk.n > MEMO or self.ids.n > SYMBOLS or self.text.n > SYMBOLS:
            self.clear()
        given = np.array([bool(t) for t in texts], bool)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        raw = b" ".join((b"", *(t for t in texts if t)))
        counts, same = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        if not raw:
            return np.zeros(0, np.int32), counts, same
        buf = np.frombuffer(raw, np.uint8)
        begin = np.zeros(len(buf), bool)
        first = (np.cumsum(sizes) - sizes)[given]
        blank, line = buf == 32, buf == 10
        begin[1:] = (blank[1:] & ~blank[:-1]) | (line[1:] != line[:-1])
        begin[first] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        lead = np.searchsorted(starts, first)  # the first chunk of each text
        per = np.diff(np.append(lead, len(starts)))
        own = keys[given].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed & FULL)
        draws = (np.repeat(own, per) + (np.arange(len(starts)) - np.repeat(lead, per)).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        offsets = np.append(starts, len(buf)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        at, n, values = self.occurrences(coded.indices.to_numpy(), coded.dictionary.to_pylist(), draws)
        per_text = np.add.reduceat(n, lead)
        counts[given] = per_text
        ids = values[spread(at, n)]
        bytes_of = self.raw_sizes[ids]
        back = self.raw[spread(self.raw_at[ids], bytes_of)]
        if not (len(back) == len(buf) and (back == buf).all()):
            ends_of, of = np.cumsum(counts), np.flatnonzero(given)
            for i, a, b in zip(of.tolist(), (ends_of - counts)[of].tolist(), ends_of[of].tolist()):
                same[i] = self.decode(ids[a:b]) == texts[i].decode()
        return ids, counts, same

    def occurrences(self, number: np.ndarray, chunks: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence of a chunk, place and number of its ids in the last array given back."""
        known = np.fromiter((self.chunks.get(c, -1) for c in chunks), np.int64, len(chunks))
        fresh = np.flatnonzero(known < 0)
        base, sizes, codes = self.symbols([chunks[i] for i in fresh.tolist()])
        often = np.bincount(number, minlength=len(chunks))
        once = np.zeros(len(chunks), bool)
        once[fresh] = (often[fresh] == 1) | (sizes > LONG)
        keep = np.flatnonzero(~once[fresh])
        chunk = np.arange(self.text_at.n, self.text_at.n + len(keep))
        self.text_at.add(spread_ends(sizes[keep]) + self.text.n)
        self.text_n.add(sizes[keep])
        self.text.add(codes[spread(base[keep], sizes[keep])])
        self.chunks.update(zip((chunks[i] for i in fresh[keep].tolist()), chunk.tolist()))
        self.first.add(self.states(chunk, [], 0))
        known[fresh[keep]] = chunk
        single = once[number]
        live = np.flatnonzero(~single)
        state = self.first.data[known[number[live]]].astype(np.int64)
        final = np.zeros(len(number), np.int64)
        skip = self.gaps(keys[live], 0)
        for depth in range(1, DEPTH + 2):
            more = skip < self.taken.data[state]
            final[live[~more]] = state[~more]
            live, state, skip = live[more], state[more], skip[more]
            if depth > DEPTH or not len(live):
                break
            state = self.below(state, skip, depth).astype(np.int64)
            skip = skip + 1 + self.gaps(keys[live], depth)
        # What is left has an agenda of its own: deep skips and single or long chunks.
        place, count = self.at.data[final], self.n.data[final].astype(np.int64)
        alone = np.concatenate((np.flatnonzero(single), live))
        values = self.ids.data[: self.ids.n]
        if len(alone):
            where = np.zeros(len(chunks), np.int64)
            where[fresh] = base + self.text.n
            size = np.zeros(len(chunks), np.int64)
            size[fresh] = sizes
            deep = np.flatnonzero(~once & (known >= 0))
            where[deep], size[deep] = self.text_at.data[known[deep]], self.text_n.data[known[deep]]
            own = keys[alone]
            ids, n, _ = self.worked(
                where[number[alone]], size[number[alone]], np.concatenate((self.text.data[: self.text.n], codes)), self.gaps(own, 0),
                lambda c, t, last: last + 1 + self.gaps(own[c], t), lambda i: self.skips(int(own[i])),
            )
            place[alone], count[alone] = spread_ends(n) + len(values), n
            values = np.concatenate((values, ids))
        return place, count, values

    def symbols(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sizes and symbols of chunks."""
        raw = b"".join(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        wide = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
        if wide.any():
            sizes -= np.diff(np.append(0, np.cumsum(wide)[np.cumsum(sizes) - 1]))
        codes = self.of_code[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
        return spread_ends(sizes), sizes, codes

    def encode(self, text: str, key: int = 0) -> list[int]:
        """The ids of a text; ``key`` (the document's) varies the segmentation."""
        return self.encode_many([text.encode()], np.array([key], np.int64))[0].tolist()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        raw = self.raw[spread(self.raw_at[ids], self.raw_sizes[ids])].tobytes()
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()


def spread_ends(sizes: np.ndarray) -> np.ndarray:
    """The starts of runs that follow each other."""
    return np.cumsum(sizes) - sizes


def _shared(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        raw = f.read(MAX_MODEL + 1)
    if len(raw) > MAX_MODEL:
        raise ValueError(f"the model is larger than {MAX_MODEL} bytes")
    return docs.sparkSession.sparkContext.broadcast(tables(raw))


def encoded(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``(doc_id, ids, lossless)``: the piece ids of every text, and whether they decode to it.

    With ``digest``, ``(doc_id, n_tokens, ids_sha256, lossless)`` as ``digests`` would give: the ids are made, decoded and
    digested in one place and do not travel.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, dropout, seed)
        for b in batches:
            keys, texts = b.column("_key").to_numpy(), [x if x is None else utf8(x) for x in b.column("_text").cast(pa.binary()).to_pylist()]
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text or b"")
                if size >= GROUP or i + 1 == len(texts):
                    ids, counts, same = pieces.encode_many(texts[start : i + 1], keys[start : i + 1])
                    own, none = b.column("doc_id").slice(start, i + 1 - start), np.array([t is None for t in texts[start : i + 1]])
                    kept = pa.array(same, pa.bool_(), mask=none)
                    if digest:
                        raw, ends = ids.astype("<i4", copy=False), np.cumsum(counts)
                        hashes = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip((ends - counts).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([own, pa.array(counts), pa.array(hashes), kept], names=DIGESTS)
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids), mask=pa.array(none))
                        yield pa.RecordBatch.from_arrays([own, lists, kept], names=["doc_id", "ids", "lossless"])
                    start, size = i + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string")).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, lossless boolean" if digest else f"doc_id {kind}, ids array<int>, lossless boolean")


def decoded(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of piece ids."""
    shared = _shared(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for b in batches:
            text = [None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, lossless)``; the digest is over the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("ids")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy().astype("<i4", copy=False)
            ids = [flat[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), b.column("lossless")], names=DIGESTS)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, lossless boolean")


def query(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), digest=True)
