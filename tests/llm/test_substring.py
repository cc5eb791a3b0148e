import hashlib
import re

import pytest

from ferrule.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    def key(r):
        return 2**63 - 1 if r[0] is None else r[0]

    least = {}
    lists = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, lists, strict=True):
        for p in range(len(w) - window + 1):
            at = tuple(w[p : p + window])
            least[at] = min(least.get(at, key(r)), key(r))
    out = []
    for r, w in zip(rows, lists, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < key(r):
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "levels"), [(50, 1), (50, 2), (9, 1), (2, 1)])
def test_against_brute_force(docs, rows, window, levels):
    got = substring.deduplicated(docs, window, levels).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute(rows, window)


def test_empty(no_docs):
    assert substring.deduplicated(no_docs).count() == 0
