import re
from itertools import combinations

import numpy as np

from ferrule.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def brute(rows, k, percent):
    sets = [sets_of(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_against_brute_force(docs, rows):
    for k, percent, symbols in ((3, 85, 64), (5, 80, 96)):
        got = minhash.near_duplicates(docs, k, percent, symbols).collect()
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, k, percent)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_kept_leaves_one_row_of_each_group(docs, rows):
    left = minhash.kept(docs)
    assert left.columns == docs.columns
    ids = [x.doc_id for x in left.collect()]
    expected = {(c if n else i) for i, n, c in brute(rows, 5, 80)}
    assert set(ids) == expected
    assert len([i for i in ids if i == 5]) == 1


def test_empty(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.kept(no_docs).count() == 0


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    for symbols, percent in ((64, 85), (96, 80)):
        radius = minhash.radius_for(symbols, percent)
        chunks = radius // 2 + 1
        for _ in range(300):
            a = rng.integers(0, 65536, symbols).astype(np.uint16)
            b = a.copy()
            b[rng.permutation(symbols)[:radius]] ^= 1
            ka, kb = minhash.index_keys(np.stack([a, b]), chunks)
            assert set(ka) & set(kb)
