import itertools
import math
import random

import numpy as np

from ferrule.llm import decontam

from .conftest import words


def test_masks_find_all_errors_that_are_allowed():
    for size in range(8, decontam.WINDOW + 1):
        wrong = size - math.ceil(size * decontam.PERCENT / 100)
        for errors in itertools.combinations(range(size), wrong):
            assert any(
                all(p + j not in errors for j, c in enumerate(mask) if c == "1") for mask in decontam.MASKS for p in range(size - len(mask) + 1)
            ), errors


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 8, 13, 20, 45, 60])] + [(90, None), (91, ""), (None, "x y z")]
    rows = [(1000, None), (1001, ""), (1002, "short text")]
    for i in range(80):
        own = words(rng, rng.randrange(0, 80))
        item = rng.choice(items[:6])[1].split()
        for _ in range(rng.randrange(0, 6)):
            item[rng.randrange(len(item))] = "wrong"
        cut = rng.randrange(0, len(own) + 1)
        rows.append((i, " ".join(own[:cut]) + "\n" + ", ".join(item).upper() + ". " + " ".join(own[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontam.found_items(docs, benchmark).collect()}
    blocks = {x.doc_id: x.item_ids for x in decontam.found_items(docs, benchmark, block_items=2).collect()}
    assert got == blocks
    bare = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    for i, text in rows:
        w, expected = bare(text), []
        for k, item in items:
            v = bare(item)
            if k is None or not v:
                continue
            size = min(13, len(v))
            need = size if len(v) < 8 else math.ceil(size * 0.8)
            good = any(
                sum(w[d + j] == v[j] for j in range(a, a + size)) >= need
                for d in range(-len(v), len(w) + 1)
                for a in range(max(0, -d), min(len(v), len(w) - d) - size + 1)
            )
            if good:
                expected.append(k)
        assert got[i] == expected, (i, got[i], expected)
    assert sorted(x.doc_id for x in decontam.clean(docs, benchmark).collect()) == sorted(i for i, _ in rows if not got[i])


def test_empty_sides(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.found_items(no_docs, none).count() == 0
    assert not decontam.found_items(docs, none).where("contaminated").count()
    assert decontam.clean(docs, none).columns == docs.columns


def test_overlap_at_the_edges():
    a = np.arange(20, dtype=np.uint64)
    assert decontam.overlaps(a, a[5:], 5)
    assert not decontam.overlaps(a[:5], a, 0)
    assert decontam.overlaps(a[7:], a, -7)


def test_short_items_with_one_wrong_word():
    for size in range(1, 8):
        item = [f"w{size}x{j}" for j in range(size)]
        matcher = decontam.Matcher([(size, " ".join(item))])
        for at in range(size):
            one = ["a", "b", *item[:at], "wrong", *item[at + 1 :], "c"]
            assert list(matcher.find([" ".join(one).encode()])) == [[size] if size >= 5 else []]
            if size > 1:
                two = [x if x != item[at - 1] else "other" for x in one]
                assert list(matcher.find([" ".join(two).encode()])) == [[]]
        assert list(matcher.find([" ".join(["a", *item]).encode()])) == [[size]]
