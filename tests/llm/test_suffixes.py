import random

import numpy as np
import pytest

from stockloom.llm import suffixes


def plain_removal(rows, length, keep_first):
    """rows: (doc_id, text); returns (doc_id, n_bytes, spans, kept) of each."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for i in order:
        for p in range(len(data[i]) - length + 1):
            seen.setdefault(data[i][p : p + length], []).append((i, p))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        gone = bytearray(len(data[i]))
        for p in range(len(data[i]) - length + 1):
            places = seen[data[i][p : p + length]]
            if len(places) > 1 and not (keep_first and places[0] == (i, p)):
                gone[p : p + length] = b"\1" * length
        spans, kept = [], bytes(b for b, g in zip(data[i], gone, strict=True) if not g)
        for p, g in enumerate(gone):
            if g and (not p or not gone[p - 1]):
                spans.append([p, p])
            if g:
                spans[-1][1] = p + 1
        out.append((doc_id, len(data[i]), tuple(map(tuple, spans)), kept))
    return sorted(out, key=repr)


def removed(docs, **how):
    got = suffixes.remove_repeats(docs, **how).collect()
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got), key=repr)


@pytest.fixture(scope="module")
def passages():
    """Shared passages of many lengths in different surroundings, near copies, copies, periodic text and repeats in one text."""
    rng = random.Random(11)
    letters = "abcdefghij klmnop qrstuvwxyzéß"

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [noise(rng.randint(44, 180)) for _ in range(12)]
    rows = [(i, "".join(noise(rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(1, 5)))) for i in range(90)]
    base = noise(700)
    rows += [(200 + i, base[:i] + "#" + base[i + 1 :]) for i in range(0, 700, 60)]
    rows += [(300, base), (301, base), (302, "x" * 900), (303, "ab" * 300 + noise(50) + "ab" * 100), (304, passages[0] * 3), (305, noise(59)), (306, noise(60))]
    rows += [(310, None), (311, ""), (None, base), (None, None)]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("hot", [1024, 2])
def test_all_copies_go(spark, passages, hot):
    docs = spark.createDataFrame(passages + [(5, passages[5][1])], SCHEMA).repartition(6)
    assert removed(docs, length=60, gram=32, keep_first=False, hot=hot) == plain_removal(passages + [(5, passages[5][1])], 60, False)


@pytest.mark.parametrize("hot", [1024, 2])
def test_first_copy_stays(spark, passages, hot):
    docs = spark.createDataFrame(passages, SCHEMA).repartition(6)
    assert removed(docs, length=60, gram=32, keep_first=True, hot=hot) == plain_removal(passages, 60, True)


def test_awkward_rows(docs, rows, none):
    pairs = [(r[0], r[1]) for r in rows]
    assert removed(docs, keep_first=False) == plain_removal(pairs, 200, False)
    # equal rows: one of them is the first
    got, want = removed(docs, keep_first=True), plain_removal(pairs, 200, True)
    assert got == want
    assert suffixes.remove_repeats(none).count() == 0 and suffixes.remove_repeats(none, keep_first=False).count() == 0


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    words = ["w%03d" % i for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(4000))
    rows = [(1, long), (2, long[3000:9000] + "!" + long[12000:12250]), (3, "z" * 5000 + long[17:260])]
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    assert removed(spark.createDataFrame(rows, SCHEMA), keep_first=False) == plain_removal(rows, 200, False)


def test_previous_factors_against_comparison():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 24)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def shared(a, b, text=text):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n

        longest, source = suffixes.previous_factors(order, [0, *(shared(a, b) for a, b in zip(order, order[1:], strict=False))])
        for i in range(len(text)):
            assert longest[i] == max((shared(i, j) for j in range(i)), default=0)
            assert not longest[i] or source[i] < i and shared(i, source[i]) == longest[i]


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    for a, b in ((0, 1000), (31, 2044)):
        data[b : b + 300] = data[a : a + 300]
        first, count, place, anchor, _ = suffixes.anchors(data, np.ones(len(data), dtype=bool), 100, 40)
        of = np.repeat(np.arange(len(first)), count)
        assert (np.concatenate([np.arange(f, f + n) for f, n in zip(first, count, strict=True)]) == np.arange(2901)).all()
        for i in range(201):
            assert place[of[a + i]] - a == place[of[b + i]] - b and anchor[of[a + i]] == anchor[of[b + i]]
