"""SimHash fingerprints, links and classes against plain loops."""

import random

import xxhash

from harborlens.llm.simhash import fingerprint, keep_one, links, near_duplicates

SCHEMA = "doc_id long, text string, component string, fingerprint int"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes) > 0)


def components(prints, most=2):
    """id -> smallest id reachable, from {id: fingerprint} by comparing all pairs."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "one two", "A b C d", "x " * 70_000, "é É ü" * 3, "same same same same"):
        assert int.from_bytes(fingerprint(None if text is None else text.encode()), "big") == plain_fingerprint(text)


def test_links_are_complete(spark):
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    for centre in list(prints)[:40]:
        for _ in range(3):
            prints.add(centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    hot = rnd.getrandbits(64)
    while len(prints) < 800:  # a dense group: buckets far beyond the pair limit
        prints.add(hot ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64)) * rnd.randrange(2))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = dict(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(i, signed(f)) for i, f in table.items()], "id long, fp long")
    parent = {i: i for i in table}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for edge in links(frame).collect():
        assert (table[edge.src] ^ table[edge.dst]).bit_count() <= 2
        a, b = sorted((find(edge.src), find(edge.dst)))
        parent[b] = a
    assert {i: find(i) for i in table} == components(table)


def texts():
    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    base = [rnd.choices(vocabulary, k=400) for _ in range(25)]
    out = []
    for i in range(120):
        text = list(base[i % 25])
        if i % 3:
            text[rnd.randrange(400)] = "changed"
        out.append((i, " ".join(text), "x", i))
    return out + [(500, None, None, None), (501, "", "x", 1), (502, " \n", "x", 1), (503, "two words", "x", 1), (504, "TWO words", "x", 1), (3, out[3][1], "x", 1)]


def test_near_duplicates(spark):
    data = texts()
    got = near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    prints = {d: plain_fingerprint(t) for d, t, *_ in data}
    want = components(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_keep_one(spark):
    data = texts() + [(None, "an id is missing", "x", 1), (None, "an id is missing", "x", 1)]
    got = keep_one(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "text", "component", "fingerprint"]
    want = components({d: plain_fingerprint(t) for d, t, *_ in data if d is not None})
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert got.where("doc_id is null").count() == 1


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
