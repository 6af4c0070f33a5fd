import random
from collections import Counter

import pytest

from starmill.llm import leakage
from starmill.llm.leakage import build_index, leaks, search, search_near, words_of

WORDS = "the a of quarry pebble loom walnut heron engine flint tarn obelisk reed spindle buoy rudder hearth gimlet causeway orchard".split()


def brute(docs, items, need):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, u in items:
            v = words_of(u)
            best = 0
            row = [0] * (len(v) + 1)
            for x in w:
                new = [0] * (len(v) + 1)
                for k, y in enumerate(v):
                    if x == y:
                        new[k + 1] = row[k] + 1
                        best = max(best, new[k + 1])
                row = new
            if best >= need:
                out[d, i] = best
    return out


@pytest.fixture(scope="module")
def data():
    r = random.Random(1)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 40)))) for k in range(30)] + [(90, None), (91, ""), (92, "a a a a a a a a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "a " * 14), (3, "a " * 11)]
    for k in range(4, 300):
        words = [r.choice(WORDS) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            v = (r.choice(items[:30])[1]).split()
            a = r.randrange(len(v))
            words[len(words) // 2 : len(words) // 2] = v[a : a + r.randrange(8, 30)]
        text = "\n+".join(" ".join(words[j : j + 5]) for j in range(0, len(words), 5))
        docs.append((k, text.upper() if k % 3 == 0 else text.replace("o", "o­").replace("quarry", "ｑuarry") if k % 3 == 1 else text))
    return docs, items


def tables(spark, data):
    docs, items = data
    return spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")


@pytest.mark.parametrize("segment, block", [(1_000_000, 1_000_000), (500, 100), (1, 1)])
def test_equals_brute_force(spark, data, segment, block):
    """Whatever the sizes of segments and blocks of items."""
    d, i = tables(spark, data)
    index = build_index(d.repartition(2), "doc", "text", segment_words=segment)
    i = i.limit(8) if block == 1 else i  # each item is a pass of its own
    items = [tuple(r) for r in i.collect()]
    got = [tuple(x) for x in search(index, i, "item", "text", block_words=block).collect()]
    want = brute(data[0], items, 12)
    assert len(want) > (2 if block == 1 else 20) and sorted(got) == sorted((a, b, n) for (a, b), n in want.items())


def test_another_test_set_is_answered_from_the_same_index(spark, data):
    d, i = tables(spark, data)
    index = build_index(d, "doc", "text")
    other = [(7, data[0][40][1]), (8, "words that no document has, " * 5)]
    j = spark.createDataFrame(other, "item bigint, text string")
    for asked, items in ((i, data[1]), (j, other)):
        assert sorted(tuple(x) for x in search(index, asked, "item", "text").collect()) == sorted((a, b, n) for (a, b), n in brute(data[0], items, 12).items())
    # the index holds every word of every document
    posted = index.where("term IS NOT NULL").selectExpr("sum(size(positions))").first()[0]
    assert posted == sum(len(words_of(t)) for _, t in data[0])


def brute_near(docs, items, need, reach):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, u in items:
            v = words_of(u)
            for k in range(len(v) - need + 1):
                wanted = Counter(v[k : k + need])
                if not wanted.keys() <= set(w):
                    continue
                for n in range(need, reach + 1):
                    if any(not wanted - Counter(w[a : a + n]) for a in range(len(w) - n + 1)):
                        out[d, i] = min(n, out.get((d, i), n))
                        break
    return out


def test_near_matches(spark, data):
    r = random.Random(5)
    docs = list(data[0])[:60]
    for k in range(1000, 1030):
        v = words_of(data[1][k % 30][1])[:12]
        mixed = v + [r.choice(WORDS) for _ in range(r.randrange(0, 9))]
        r.shuffle(mixed)
        docs.append((k, " ".join(mixed)))
    d, i = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(data[1], "item bigint, text string")
    want = brute_near(docs, data[1], 12, 18)
    got = {(x.doc, x.item): x.n_words for x in search_near(build_index(d, "doc", "text", segment_words=300), i, "item", "text").collect()}
    assert got == want and len({n for n in want.values()}) > 3
    with pytest.raises(ValueError, match="reach"):
        search_near(build_index(d, "doc", "text"), i, "item", "text", reach=leakage.GAP + 1)


def test_string_keys_and_repeated_rows(spark):
    text = " ".join(WORDS[:13])
    d = spark.createDataFrame([("x", text), ("x", text), (None, text), ("y", text + " z" * 2_000_000)], "k string, t string")
    i = spark.createDataFrame([("i", text), ("i", text)], "k string, t string")
    assert sorted((r.doc or "", r.item, r.n_words) for r in leaks(d, "k", "t", i, "k", "t").collect()) == [("", "i", 13), ("x", "i", 13), ("y", "i", 13)]


def test_empty_tables(spark, data):
    docs, items = data
    d, i = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")
    assert leaks(d.where("false"), "doc", "text", i, "item", "text").collect() == []
    assert leaks(d, "doc", "text", i.where("false"), "item", "text").collect() == []


def test_words():
    assert words_of("Über​l­auf_ﬁx\r\n+x-2") == ["überlauf", "fix", "x", "2"]
    assert words_of("STRAẞE") == ["strasse"]
