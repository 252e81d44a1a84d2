import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from stratakv.llm import packing

from .conftest import EDGES, prose

ARGS = (P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN)


def bins(counts, capacity):
    slots, n = packing.plan_bins(counts, capacity)
    held = defaultdict(list)
    for s, count in counts.items():
        at = np.flatnonzero(slots["length"] == s)
        ranks = slots["rank"][at]
        for rank in range(count):
            k = at[np.searchsorted(ranks, rank, side="right") - 1]
            over = rank - slots["rank"][k]
            held[int(slots["bin"][k] + over // slots["copies"][k])].append((int(slots["offset"][k] + over % slots["copies"][k] * s), s))
    assert sorted(held) == list(range(n))
    return held


def best_fit_decreasing(counts, capacity):
    rooms = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("capacity", [12, 100, 2048])
def test_bins_are_gapless_and_few(capacity):
    rng = random.Random(capacity)
    for trial in range(25):
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 30) for _ in range(rng.randrange(0, 40))}
        held = bins(counts, capacity)
        for items in held.values():
            at = 0
            for offset, s in sorted(items):
                assert offset == at
                at += s
            assert at <= capacity and sum(3 * s > capacity for _, s in items) <= 2
        assert len(held) <= 1.02 * best_fit_decreasing(counts, capacity) + 1


@pytest.mark.parametrize("capacity", [64, 2048])
def test_table(make_docs, capacity):
    rng = random.Random(3)
    rows = EDGES + [(100 + k, prose(rng, n=rng.randrange(1, 90))) for k in range(80)] + [(500, prose(rng, n=9000)), (501, "before <|endoftext|> after")]
    own = Tokenizer.from_file(ARGS[1])
    want = []
    for doc_id, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n = len(ids)
        first = n if n <= capacity else n % capacity or capacity
        edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = packing.pack(make_docs(rows), *ARGS, capacity).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for items in held.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(held) <= 1.1 * sum(w[3] for w in want) / capacity + 1


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), *ARGS).collect() == []
