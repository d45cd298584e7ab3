"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Texts are cut where no piece of the vocabulary reaches across. The distinct cuts of a batch that are not yet
known are held as one ragged numpy array; in each round every sequence applies its lowest-rank pair, all
sequences at once, until none has a pair left. The symbols that survive are the tokens. A pair that a sequence holds
several times is applied everywhere in one round, up to the first place where that would make a pair that has to come
before the next. A long sequence is held as short ones first, which are joined again wherever the two tokens that meet
are not what the model makes of the two together; tokens of which every two neighbours are, are those of the whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
SPACE = "▁"  # how the model writes a space
NEVER = np.int64(2**62)
CHUNK = 256  # symbols of the parts in which a longer sequence is merged first


class PairTable:
    """merged piece and rank of a pair of piece numbers: an open-addressing hash table in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.merged, self.rank = np.zeros(1 << bits, dtype=np.int64), np.full(1 << bits, NEVER)
        keys = left << 32 | right
        at, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            slots = at[rest]
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[rest[free]]  # of several keys for a slot, one stays
            own = free & (self.keys[slots] == keys[rest])
            self.merged[slots[own]], self.rank[slots[own]] = merged[rest[own]], rank[rest[own]]
            rest = rest[~own]
            at[rest] = (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged, rank) of each pair; rank NEVER if it makes no piece."""
        keys = left << 32 | right
        at = self._home(keys)
        merged, rank = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), NEVER)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        while len(rest):
            there = self.keys[at[rest]]
            own = there == keys[rest]
            merged[rest[own]], rank[rest[own]] = self.merged[at[rest[own]]], self.rank[at[rest[own]]]
            rest = rest[~own & (there >= 0)]
            at[rest] = (at[rest] + 1) & self.mask
        return merged, rank


class PieceCounter:
    """Counts tokens as the model would, without begin or end tokens.

    Counts of up to `remembered` cuts, of up to `held` characters together, are kept; none of over `longest`.
    """

    def __init__(self, path: str, remembered: int = 400_000, held: int = 6_000_000, longest: int = 64):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (n, -model.get_score(i)) for n, i in enumerate(own)}
        scores = sorted({s for _, s in pieces.values()})
        rank = {s: n for n, s in enumerate(scores)}
        pairs = [(pieces[p[:k]][0], pieces[p[k:]][0], n, rank[s]) for p, (n, s) in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 4).T)
        inner = {ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p, p[1:])}
        self.inner = np.array(sorted(inner), dtype=np.int64)  # neighbours within pieces: only there can symbols merge
        self.piece = np.full(0x110000, -1, dtype=np.int64)
        for p, (n, _) in pieces.items():
            if len(p) == 1:
                self.piece[ord(p)] = n
        starts = (0, 0x80, 0x800, 0x10000, 0x110000)
        self.width = np.repeat(np.arange(1, 5), np.diff(starts))
        joined = [p for p in pieces if regex.search(f"[^{SPACE}]{SPACE}", p)]
        if joined or any("\n" in p for p in pieces):
            raise ValueError("pieces of this model reach across white space")
        self.cuts = regex.compile(f"{SPACE}*+[^{SPACE}\n]++|{SPACE}++|\n").findall
        self.remembered, self.held, self.longest, self.known, self.size = remembered, held, longest, {}, 0
        probe = f" a  b\n\tc{SPACE}d \u00e9\ufb01 \U0001f600   "
        if self.count([probe]) != [len(model.encode(probe))]:
            raise ValueError("this model normalises text")

    def count_sequences(self, sequences: list[str]) -> list[int]:
        """Surviving symbols of each sequence; a character outside the vocabulary counts its UTF-8 bytes."""
        if not sequences:
            return []
        points = np.frombuffer("".join(sequences).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        whole = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        ids = self.piece[points]
        weight = np.where(ids < 0, self.width[points], 1)
        # a sequence is cut further between characters that are neighbours in no piece
        apart = np.ones(len(points), dtype=bool)
        near = points[:-1] << 32 | points[1:]
        place = np.searchsorted(self.inner, near).clip(max=len(self.inner) - 1)
        apart[1:] = (self.inner[place] != near) | (whole[1:] != whole[:-1])
        owner = np.cumsum(apart) - 1
        alive = self._whole(ids, owner)
        return np.bincount(whole, weight * alive, len(sequences)).astype(np.int64).tolist()

    def _whole(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each symbol whether one that survives starts there, for sequences of any length."""
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(np.append(begin, len(ids)))
        if sizes.max(initial=0) <= 2 * CHUNK:
            return self._rounds(ids, owner)
        place = np.arange(len(ids)) - np.repeat(begin, sizes)
        cut = (place == 0) | (np.repeat(sizes > 2 * CHUNK, sizes) & (place % CHUNK == 0))
        joints = np.flatnonzero(cut & (place > 0))
        alive = self._rounds(ids, np.cumsum(cut))
        while len(joints):
            starts = np.append(np.flatnonzero(alive), len(ids))
            k = np.searchsorted(starts, joints)
            first, size = starts[k - 1], starts[k + 1] - starts[k - 1]  # the two tokens that meet
            of = np.repeat(np.arange(len(joints)), size)
            at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of]
            wrong = np.bincount(of, self._rounds(ids[at], of) != alive[at], len(joints)) > 0
            if not wrong.any():
                break
            cut[joints[wrong]] = False
            group = np.cumsum(cut)
            again = np.isin(group, group[joints[wrong]])
            alive[again] = self._rounds(ids[again], group[again])
            joints = joints[~wrong]
        return alive

    def _rounds(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each symbol whether one that survives starts there. Symbols of a sequence lie together."""
        alive, place, ids = np.ones(len(ids), dtype=bool), np.arange(len(ids)), ids.copy()
        merged, rank = self._pairs(ids, owner)
        while len(ids):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
            best = np.minimum.reduceat(rank, begin)
            ready = self._lowest(ids, owner, merged, rank, which, best)
            ids[ready] = merged[ready]
            alive[place[ready + 1]] = False
            live = (best < NEVER)[which]  # sequences without a pair are done
            live[ready + 1] = False
            touched = np.zeros(len(ids), dtype=bool)
            touched[ready] = touched[np.maximum(ready - 1, 0)] = True
            touched[np.maximum(ready - 2, 0)] = True  # the place before may be gone itself
            ids, owner, place, merged, rank, touched = (x[live] for x in (ids, owner, place, merged, rank, touched))
            again = np.flatnonzero(touched)
            if len(again):
                merged[again], rank[again] = self._pairs(ids, owner, again)
        return alive

    def _lowest(self, ids: np.ndarray, owner: np.ndarray, merged: np.ndarray, rank: np.ndarray, which: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Places of the pairs to apply: in each sequence those of lowest rank, from the left, that don't overlap.

        One after the other, each would make a pair with its neighbours as they are then: the symbol before it, which
        may be merged already, and the one after it, which is not. Where such a pair ranks no higher than the lowest,
        it has to come before the rest, so what follows in that sequence waits.
        """
        ready = np.flatnonzero((rank == best[which]) & (rank < NEVER))
        first = np.diff(ready, prepend=-2) != 1  # begins a run of overlapping places, of which every other one counts
        run = np.maximum.accumulate(np.where(first, np.arange(len(ready)), 0))
        ready = ready[(np.arange(len(ready)) - run) % 2 == 0]
        seq = which[ready]
        several = (np.diff(seq, prepend=-1) == 0) | (np.diff(seq, append=-1) == 0)
        if not several.any():
            return ready
        at, n = ready[several], len(ids)
        new = merged[at]
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (owner[after] == owner[at]), ids[after], -1)
        chosen = np.zeros(n + 2, dtype=bool)
        chosen[at] = True
        left = np.where(chosen[at - 2] & (at >= 2), merged[at - 2], ids[at - 1])
        left = np.where((at >= 1) & (owner[at - 1] == owner[at]), left, -1)
        low = best[which[at]]
        stop = (self.pairs.find(new, right)[1] <= low) | (self.pairs.find(left, new)[1] <= low)
        before = np.cumsum(stop) - stop
        begins = np.diff(which[at], prepend=-1) > 0
        start = np.maximum.accumulate(np.where(begins, before, 0))
        keep = np.ones(len(ready), dtype=bool)
        keep[several] = before == start
        return ready[keep]

    def _pairs(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """merged and rank of the pair that starts at each position."""
        at = np.arange(len(ids)) if at is None else at
        after = np.minimum(at + 1, len(ids) - 1)
        right = np.where((after > at) & (owner[after] == owner[at]), ids[after], -1) if len(ids) else at
        return self.pairs.find(ids[at], right)

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.cuts(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) >= self.remembered or self.size >= self.held:
            self.known, self.size = {}, 0
        known = self.known
        new = list({c for x in cuts for c in x if c not in known})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            known.update(zip(part, self.count_sequences(part), strict=True))
        counts = [sum(map(known.__getitem__, x)) for x in cuts]
        for c in new:
            if len(c) > self.longest:
                del known[c]
            else:
                self.size += len(c)
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter for each worker process, kept between its tasks."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """A row for each document: n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null text counts as empty (0 bytes, 0 tokens). A null doc_id stays null, repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored. One pass without a shuffle.
    """

    def start():
        counts = counter(path)

        def work(ids, texts):
            texts = [t or "" for t in texts]
            n, at = [], 0
            while at < len(texts):  # about a million characters at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                n += counts.count(texts[at:end])
                at = end
            return ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return work

    return map_rows(docs.select("doc_id", "text"), SCHEMA, start)
