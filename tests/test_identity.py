"""Similar names and fingerprints against comparing everything with everything."""

import random

from railbird.operators import identity


def _names(n=260, seed=3):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefg小雨滴答落豺狼") for _ in range(rnd.randint(3, 9))) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        s = list(rnd.choice(base))
        op, i = rnd.randrange(3), rnd.randrange(len(s))
        if op == 0:
            s[i] = rnd.choice("abcdefg雨I1")
        elif op == 1:
            s.insert(i, rnd.choice("abc落"))
        elif len(s) > 3:
            s.pop(i)
        out.add("".join(s))
    return sorted(out)


def test_similar_names_misses_nothing(spark):
    names = [(n, (i * 7) % 11 + 1) for i, n in enumerate(_names())]
    for cutoff in (0.6, 0.75, 0.85):
        got = {(r.a, r.b) for r in identity.similar_names(spark.createDataFrame(names, "player_name string, hands long"), cutoff=cutoff).collect()}
        ranked = sorted(names, key=lambda x: (-x[1], x[0]))
        want = {(a, b) for i, (a, _) in enumerate(ranked) for b, _ in ranked[i + 1:] if identity.name_ratio(a, b) >= cutoff}
        assert got == want and want


def test_clusters(spark):
    names = spark.createDataFrame([(n,) for n in ["abc", "abcd", "abce", "xyz", "chain1", "chain2", "chain3", "chain44", "TempUser_a"]], "player_name string")
    pairs = spark.createDataFrame([("abc", "abcd"), ("abce", "abc"), ("chain1", "chain2"), ("chain2", "chain3"), ("chain3", "chain44"),
                                   ("TempUser_a", "xyz")], "a string, b string")
    got = {r.player_name: r.canonical for r in identity.name_clusters(names, pairs).collect()}
    assert got == {"abc": "abcd", "abcd": "abcd", "abce": "abcd", "xyz": "xyz", "chain1": "chain44", "chain2": "chain44",
                   "chain3": "chain44", "chain44": "chain44"}


def test_fingerprints_up_to_the_last_bit(spark):
    rnd = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    base = [rnd.getrandbits(64) for _ in range(40)]
    registry = [(signed(b), f"p{i}" if i % 5 else f"TempUser_{i}") for i, b in enumerate(base)]
    readings = []
    for i, b in enumerate(base):
        for flips in (0, 5, 6, 7, 9):
            h = b
            for bit in rnd.sample(range(64), flips):
                h ^= 1 << bit
            readings.append((i, flips, signed(h)))
    out = identity.nearest_fingerprints(spark.createDataFrame(readings, "i int, flips int, phash long"),
                                        spark.createDataFrame(registry, "phash long, name string")).collect()
    assert len(out) == len(readings)
    for r in out:
        want = f"p{r.i}" if r.flips <= 6 and r.i % 5 else None
        assert (r.matched_name, r.distance) == (want, r.flips if want else None)


def test_dark_avatars_find_their_nearest(spark):
    """Half the avatars have a few bits in one corner only; with crowded keys the result equals comparing all with all."""
    rnd = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    dark = lambda: sum(1 << b for b in rnd.sample(range(20), rnd.randrange(5)))
    known = list({dark() for _ in range(400)}) + [rnd.getrandbits(64) for _ in range(300)]
    registry = [(signed(h), f"p{i}" if i % 9 else f"TempUser_{i}") for i, h in enumerate(known)]
    asked = [dark() ^ rnd.choice([0, 1 << 63, 3 << 40, 0x7F << 50]) for _ in range(150)] + [rnd.choice(known) ^ (1 << rnd.randrange(64)) for _ in range(100)]
    readings = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(asked)] + [(999, None)], "i int, phash long")
    names = spark.createDataFrame(registry, "phash long, name string")
    want = {999: (None, None)}
    for i, h in enumerate(asked):
        d, name = min(((h ^ k).bit_count(), n) for k, (_, n) in zip(known, registry, strict=True))
        want[i] = (name, d) if d <= 6 and not name.startswith("TempUser_") else (None, None)
    for crowded in (5, 10**6):
        got = identity.nearest_fingerprints(readings, names, crowded=crowded).collect()
        assert {r.i: (r.matched_name, r.distance) for r in got} == want
    assert sum(n is not None for n, _ in want.values()) > 150


def test_bits_are_dealt_by_how_they_split(spark):
    df = spark.createDataFrame([(v,) for v in (1, 3, 5, 5, 7, 7, 0, 0)], "k long")
    assert identity.bit_order(df, "k")[:3] == [2, 1, 0]
