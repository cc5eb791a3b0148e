import random

from ferrule.operators.ordering import numbered


def test_numbers_totals_and_ranks_of_a_skewed_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + [None, "a", "ß", "z"]), rng.randrange(400) if k % 50 else None, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "folder string, place long, id long").repartition(7)
    got = {r["id"]: (r["n"], r["t"], r["r"]) for r in numbered(df, ["folder"], ["place", "id"], "n", "t", "r").collect()}
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    expected = {}
    for rank, g in enumerate(groups):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected |= {r[2]: (n, len(mine), rank) for n, r in enumerate(mine)}
    assert got == expected


def test_ties_and_no_rows(spark):
    same = spark.createDataFrame([("a", 1)] * 9, "folder string, place long")
    assert sorted(r["number"] for r in numbered(same, ["folder"], ["place"]).collect()) == list(range(9))
    assert numbered(same.limit(0), ["folder"], ["place"], rank="r").count() == 0
