import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ferrule.llm import pitman

SCHEMA = "doc_id long, text string, word string, bucket long, n long"


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def scored(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    return [r.asDict() for r in pitman.score(df, **more).collect()]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    after = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(n):
        w, out = rng.choice(words), []
        for _ in range(rng.randrange(3, 30)):
            out.append("The" if rng.random() < 0.35 else w)
            w = rng.choice(after[w]) if w in after and rng.random() < 0.9 else rng.choice([*words, f"rare{rng.randrange(500)}"])
        rows.append((i, " ".join(out)))
    return rows


def tables_exactly(c, weight, d):
    """Distribution of the number of tables of one dish: generalised Stirling numbers times powers of the weight."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + (n - d * t) * (row[t] if t < len(row) else 0.0) for t in range(1, n + 2)]
    p = np.array([x * weight**t for t, x in enumerate(row)])
    return p / p.sum()


@pytest.mark.parametrize(("c", "weight", "d"), [(2, 0.3, 0.5), (7, 1.5, 0.8), (12, 6.0, 0.2), (40, 0.05, 0.9)])
def test_gibbs_keeps_the_exact_distribution_of_tables(c, weight, d):
    rng, n = np.random.default_rng(c), 20_000
    many, w = np.full(n, c), np.full(n, weight)
    seating = None
    for _ in range(12):
        seating = pitman.gibbs(rng, many, w, d, seating)
    got = np.bincount(seating.t, minlength=c + 1) / n
    assert abs(got - tables_exactly(c, weight, d)).max() < 0.015
    first = np.cumsum(seating.t) - seating.t
    assert (seating.opened[first] == 0).all() and (seating.opened < c).all()


def test_a_dish_with_very_many_customers_takes_few_steps():
    rng = np.random.default_rng(1)
    seating = pitman.gibbs(rng, np.array([10**9] * 50), np.full(50, 2.0), 0.5, None)
    assert 20 < seating.t.mean() < 70  # about weight * log(customers)
    again = pitman.gibbs(rng, np.array([10**9] * 50), np.full(50, 2.0), 0.5, seating)
    assert (again.t > 0).all()


def test_log_gamma_and_packing():
    x = np.array([0.05, 0.5, 1.0, 3.3, 8.0, 1e3, 1e9])
    assert np.allclose(pitman.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)
    for a in ([], [0, 0], [1, 300, 70_000, 2**63 + 5]):
        a = np.array(a, np.uint64)
        assert (pitman.unpack(pitman.pack(a)) == a).all() and (pitman.unpack(pitman.pack(a, True)) == a).all()


def reference(rows, d, strength=1.0, sweeps=60, burn=20, seed=3):
    """One customer after the other, in plain Python: scores by averaged predictive probabilities."""
    rng = random.Random(seed)
    train = [tokens(t) for i, t in rows if not held(i)]
    pairs = [p for ts in train for p in zip(["<"] + ts[:-1], ts, strict=True)]
    known = len({t for ts in train for t in ts})
    low, top = defaultdict(lambda: defaultdict(list)), defaultdict(list)  # sizes of the tables

    def parent(w):
        c, t, n, m = sum(top[w]), len(top[w]), sum(map(sum, top.values())), sum(map(len, top.values()))
        return (max(c - d[0] * t, 0) + (strength + d[0] * m) / (known + 1)) / (strength + n)

    def child(u, w):
        own = low[u]
        n, m = sum(map(sum, own.values())), sum(map(len, own.values()))
        return (max(sum(own[w]) - d[1] * len(own[w]), 0) + (strength + d[1] * m) * parent(w)) / (strength + n)

    def sit(tables, discount, weight):
        at = rng.random() * (weight + sum(tables) - discount * len(tables))
        for k, size in enumerate(tables):
            at -= size - discount
            if at < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def rise(tables):
        at = rng.randrange(sum(tables))
        for k, size in enumerate(tables):
            at -= size
            if at < 0:
                tables[k] -= 1
                if not tables[k]:
                    del tables[k]
                    return True
                return False

    def add(u, w):
        if sit(low[u][w], d[1], (strength + d[1] * sum(map(len, low[u].values()))) * parent(w)):
            sit(top[w], d[0], (strength + d[0] * sum(map(len, top.values()))) / (known + 1))

    for u, w in pairs:
        add(u, w)
    asked = {p for _, t in rows for ts in [tokens(t)] for p in zip(["<"] + ts[:-1], ts, strict=True)}
    chance = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if rise(low[u][w]):
                rise(top[w])
            add(u, w)
        if sweep >= burn:
            for p in asked:
                chance[p] += child(*p) / (sweeps - burn)
    return [sum(math.log10(chance[p]) for p in zip(["<"] + ts[:-1], ts, strict=True)) for _, t in rows for ts in [tokens(t)]]


def test_scores_are_those_of_plain_gibbs_sampling(spark, monkeypatch):
    rows, used = corpus(70), []
    monkeypatch.setattr(pitman, "_discount", lambda ones, twos: used.append(0.6) or 0.6)
    got = {r["doc_id"]: r["score"] for r in scored(spark, rows, sweeps=6, burn_in=2)}
    plain = reference(rows, (0.6, 0.6))
    ratio = [got[i] / s for (i, _), s in zip(rows, plain, strict=True)]
    assert used and 0.95 < min(ratio) and max(ratio) < 1.05 and abs(np.mean(ratio) - 1) < 0.01


def test_counts_and_base_are_exact_however_words_are_dealt(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n\t"), (None, "the w1 never learned"), (5, "a doubled id"), (1003, "ÄÖ É The THE w1 " * 60_000)]
    train = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    expected = []
    for i, x in rows:
        ts = tokens(x)
        expected.append((str(i), held(i), len(ts), sum(train[t] > 0 for t in ts), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), 4)))
    plain = None
    for size in (1 << 30, 50_000):
        got = scored(spark, rows, bucket_bytes=size)
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(expected)
        scores = {str(r["doc_id"]): r["score"] for r in got}
        plain = plain or scores
        ratio = [scores[k] / plain[k] for k in scores if k not in ("5", "None")]  # other draws: short texts differ most
        assert 0.9 < min(ratio) and max(ratio) < 1.1 and abs(np.mean(ratio) - 1) < 0.01


def test_model_beats_base_on_held_out_text(spark):
    got = [r for r in scored(spark, corpus(600)) if r["held_out"]]
    assert len(got) > 40
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


def test_no_rows_and_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    got = scored(spark, [(None, "a b"), (None, None)])
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], round(r["score"], 6)) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
