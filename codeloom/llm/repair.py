"""Re-Pair grammars of many token sequences at once.

Re-Pair replaces the most frequent pair of neighbours by a new symbol until no
pair occurs twice. Here all sequences of a batch are arrays, each sequence with
its own grammar, and a round replaces every pair that is more frequent than the
pairs it overlaps with, so that a sequence of n tokens takes about log(n)
rounds instead of one for each rule.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


_POWERS = np.cumprod(np.concatenate(([1], np.full(8191, _BASE, np.uint64))).astype(np.uint64), dtype=np.uint64)


def power(n: np.ndarray) -> np.ndarray:
    """``_BASE ** n`` modulo 2**64."""
    if len(n) and n.max() < len(_POWERS):
        return _POWERS[n]
    out, base, n = np.ones(len(n), np.uint64), np.full(len(n), _BASE), n.copy()
    while n.any():
        out = np.where(n & 1, out * base, out)
        base, n = base * base, n >> 1
    return out


class Grammars:
    """The grammars of ``n`` sequences.

    ``tokens``: 64-bit hashes of the tokens of all sequences, one after the
    other; ``owner``: the sequence of each, ascending from 0. Afterwards, for
    each sequence: ``size`` (symbols of its start rule and two for each other
    rule), ``rules``, and ``start``, a hash of the start rule's expansion,
    which doesn't depend on how the text was split into rules. ``used`` has the
    long rules: owner, hash and length of the expansion.

    ``pooled`` gives all sequences one grammar: pairs are counted over all of
    them, though no pair reaches from one into the next. Then ``seen`` has every
    repeated pair that stood in a sequence in any round, as owner and hash, and
    ``rules`` counts a rule for the first sequence that has it.
    """

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, n: int, long_rule: int = 32, pooled: bool = False):
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            self._build(tokens.astype(np.uint64), owner.astype(np.int64), n, long_rule, pooled)

    def _build(self, tokens, owner, n, long_rule, pooled):
        self.length = np.bincount(owner, minlength=n)
        symbol, value, span = tokens, mix(tokens), np.ones(len(tokens), np.int64)
        self.rules = np.zeros(n, np.int64)
        used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = np.zeros(n, np.uint64)
        done_size = np.zeros(n, np.int64)
        while len(symbol) > 1:
            content = mix(symbol[:-1] * _A + mix(symbol[1:] + _C) * _B)  # the same wherever the text stands
            pair = content if pooled else mix(content + owner[:-1].astype(np.uint64) * _C)
            same = owner[:-1] == owner[1:]
            at = np.flatnonzero(same)
            if not len(at):
                break
            order = np.argsort(pair[at])
            keys = pair[at][order]
            edge = np.concatenate(([True], keys[1:] != keys[:-1]))
            bound = np.flatnonzero(edge)
            counts = np.diff(np.append(bound, len(keys)))
            if counts.max() < 2:
                break
            # A pair's rank: its count, then bits of its content's hash, so that no two pairs of a sequence are equal. 0: it doesn't repeat.
            ranks = np.where(counts >= 2, (counts << 40) | (content[at][order][bound] >> np.uint64(24)).astype(np.int64), 0)
            rank = np.zeros(len(symbol), np.int64)
            rank[at[order]] = np.repeat(ranks, counts)
            if pooled:
                again = np.flatnonzero(rank > 0)
                self.seen.append((owner[again], content[again]))
            before, after = np.concatenate(([0], rank[:-1])), np.concatenate((rank[1:], [0]))
            top = (rank > 0) & (rank >= before) & (rank >= after)
            same_run = top & (rank == before)
            if same_run.any():  # of a run of one pair (a a a a) every other place counts, from the run's start on
                first = np.flatnonzero(rank != before)
                begin = first[np.searchsorted(first, np.flatnonzero(top), side="right") - 1]
                places = np.flatnonzero(top)
                top[places[(places - begin) & 1 == 1]] = False
            chosen = np.flatnonzero(top)
            by_pair = np.argsort(pair[chosen], kind="stable")
            ids = pair[chosen[by_pair]]
            begins = np.concatenate(([True], ids[1:] != ids[:-1]))
            lone = begins & np.concatenate((begins[1:], [True]))  # a pair that its neighbours left but one place for makes no rule
            made = chosen[by_pair[begins & ~lone]]
            if lone.any():
                several = np.ones(len(chosen), bool)
                several[by_pair[lone]] = False
                chosen = chosen[several]
            if not len(chosen):
                break
            second = chosen + 1
            symbol, value, span = symbol.copy(), value.copy(), span.copy()
            value[chosen] = value[chosen] * power(span[second]) + value[second]
            span[chosen] += span[second]
            symbol[chosen] = content[chosen]
            self.rules += np.bincount(owner[made], minlength=n)
            big = made[span[made] >= long_rule]
            used.append((owner[big], value[big], span[big]))
            keep = np.ones(len(symbol), bool)
            keep[second] = False
            symbol, value, span, owner = symbol[keep], value[keep], span[keep], owner[keep]
            # Sequences without a repeated pair are finished and leave the rounds.
            active = np.zeros(n, bool)
            active[owner[np.flatnonzero(rank[keep] > 0)]] = True
            still = active[owner]
            if not still.all():
                self._finish(owner[~still], value[~still], span[~still], done_size)
                symbol, value, span, owner = symbol[still], value[still], span[still], owner[still]
        self._finish(owner, value, span, done_size)
        self.size = done_size + 2 * self.rules
        self.used = tuple(np.concatenate(x) if used else np.zeros(0, np.int64) for x in zip(*used)) if used else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _finish(self, owner, value, span, done_size):
        """Hashes the start rules of finished sequences: a sum of their symbols' hashes, shifted by what follows."""
        if not len(owner):
            return
        done_size += np.bincount(owner, minlength=len(done_size))
        total = np.cumsum(span)
        last = np.concatenate((np.flatnonzero(owner[1:] != owner[:-1]), [len(owner) - 1]))
        end = np.zeros(len(self.start), np.int64)
        end[owner[last]] = total[last]
        shifted = value * power(end[owner] - total)
        starts = np.concatenate(([0], last[:-1] + 1))
        self.start[owner[last]] = np.add.reduceat(shifted, starts)


STRETCH, WITHIN = 32, 32  # tokens of a stretch; of so many that begin one after the other, one is kept


def stretches(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and hash of stretches of ``STRETCH`` tokens that the tokens themselves choose.

    Of every ``WITHIN`` stretches in a row the one of the least hash is kept, so
    two sequences with a passage of ``STRETCH + WITHIN - 1`` equal tokens have a
    stretch in common, whatever stands around it. A sequence shorter than that
    keeps one of its stretches.
    """
    owner, h = owner.astype(np.int64), mix(tokens.astype(np.uint64))
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = 1
        while n < STRETCH and len(h) > n:
            h, n = mix(h[:-n] * _A + mix(h[n:] + _C) * _B), 2 * n
    if n < STRETCH:
        return none
    at = np.flatnonzero(owner[: len(h)] == owner[STRETCH - 1 :])  # those within one sequence
    if not len(at):
        return none
    h, owner = h[at], owner[at]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    number = np.diff(np.append(first, len(h)))
    low, n = h, 1
    while n < WITHIN and len(low) > n:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    whole = np.flatnonzero(owner[: len(low)] == owner[WITHIN - 1 :]) if n == WITHIN else np.zeros(0, np.int64)
    few = number < WITHIN
    owners = np.concatenate((owner[whole], owner[first[few]]))
    values = np.concatenate((low[whole], np.minimum.reduceat(h, first)[few]))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    new = np.concatenate(([True], (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])))
    return owners[new], values[new]
