import random

from factlane.operators.first_holders import Windows, first_holders


def test_windows_of_equal_text_hash_alike():
    text = "ab外滩ab外滩a"
    for length in range(1, len(text) + 1):
        hashes = Windows(text).of(length)
        pieces = [text[i:i + length] for i in range(len(text) - length + 1)]
        assert len(hashes) == len(pieces) and len(set(hashes.tolist())) == len(set(pieces))
        assert all(Windows(p).of(length)[0] == h for p, h in zip(pieces, hashes))


def test_first_holders_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab外滩😀") for _ in range(rng.randrange(12)))) for i in range(300)] + [(300, None), (301, "a" * 3000)]
    asked = {"".join(rng.choice("ab外滩😀") for _ in range(rng.randrange(6))) for _ in range(200)} | {None, "zz", "a" * 2999}
    found = first_holders(
        spark.createDataFrame(rows, "ord long, value string").repartition(3),
        spark.createDataFrame([(a,) for a in asked], "wanted string"),
    ).collect()
    expected = {}
    for a in filter(None, asked):
        holding = [i for i, text in rows if text is not None and a in text]
        if holding:
            expected[a] = min(holding)
    assert dict(map(tuple, found)) == expected and len(found) == len(expected)


def test_nothing_asked(spark):
    rows = spark.createDataFrame([(1, "a")], "ord long, value string")
    assert first_holders(rows, spark.createDataFrame([("",), (None,)], "wanted string")).isEmpty()
    assert first_holders(rows.limit(0), spark.createDataFrame([("a",)], "wanted string")).isEmpty()
