import hashlib
import random
import zlib

from pyspark.sql import functions as F

from ferrule.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, kids string, tree long"
OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests, at):
    """(root, siblings) of digests for the one at a place."""
    siblings = []
    while len(digests) > 1:
        run = at // 16 * 16
        siblings += [d for k, d in enumerate(digests[run : run + 16], run) if k != at]
        digests, at = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)], at // 16
    return digests[0], siblings


def fold(digests, at, mine):
    while len(digests) > 1:
        run = at // 16 * 16
        kids = list(digests[run : run + 16])
        kids[at - run] = mine
        mine = sha(*kids)
        digests, at = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)], at // 16
    return mine


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n in (r[:5] for r in rows):
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        own = leaf(doc_id, source, lang, n, text)
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n, lowered(text)) if touched else own, doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(by[s]) for s in sources]
    subroots = [climb([x[2] for x in t], 0)[0] for t in trees]
    out = []
    for k, t in enumerate(trees):
        digests = [x[2] for x in t]
        for at, x in enumerate(t):
            root, above = climb(subroots, k)
            folded = fold(subroots, k, fold(digests, at, x[3]))
            out.append((x[4], x[2], subroots[k], root, sha(*climb(digests, at)[1], *above), folded, folded == root))
    return sorted(out, key=str)


def proofs(df, **more):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted((tuple(r[c] for c in OUT) for r in merkle.proofs(merkle.leaves(df, touched, {"text": low}), **more).collect()), key=str)


def table(n, sources, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Ähm, Ein TEXT " * rng.randrange(5), "lower only"])
        rows.append((i if i % 97 else None, text, rng.choice(["en", None]), rng.choice(sources), rng.choice([None, i]), "n", "k", 7))
    return rows + rows[:3]  # repeated rows


def test_equals_brute_force_with_a_hot_source(spark):
    rows = table(1500, ["hot"] * 8 + [None, "", "ß", "a", "one"]) + [(9_999, "X", "en", "alone", 1, "n", "k", 7), (10_000, "x" * 300_000 + "Y", "en", "alone2", 1, "n", "k", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = brute(rows)
    assert proofs(df) == expected
    assert proofs(df, upper_nodes=4) == expected  # both climbs
    assert 0 < sum(not x[-1] for x in expected) < len(expected) / 5 * 1.5


def test_many_sources_and_single_rows(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 300:03d}", i, "n", "k", 7) for i in range(420)]
    assert proofs(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert proofs(spark.createDataFrame(rows, SCHEMA), upper_nodes=3) == brute(rows)


def test_one_row_one_source_and_no_rows(spark):
    one = [(5, "AB", None, None, None, "n", "k", 7)]
    assert proofs(spark.createDataFrame(one, SCHEMA)) == brute(one)
    rows = [(i, "AB", "en", "s", 2, "n", "k", 7) for i in range(17)]
    assert proofs(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert proofs(spark.createDataFrame([], SCHEMA)) == []
