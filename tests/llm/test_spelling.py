import random
import re
import zlib
from collections import Counter

import pytest

from harborlens.llm import spelling
from harborlens.llm.queries import LLM_QUERIES

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(docs, every=199):
    out = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += bool(run)
    out.pop("", None)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, least_n=5, least_size=6, times=5):
    """Every word against every other."""
    words = {w: n for w, n in counts.items() if n >= least_n and len(w) >= least_size}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed,letters,block", [(1, "abc", 4096), (2, "abc", 20), (3, "aé名\U0001f600", 50), (4, "abcdefgh", 4096)])
def test_variants_equal_all_pairs(spark, seed, letters, block, monkeypatch):
    """Crowded words, in whole blocks and in parts, in many small tiles."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    draw = random.Random(seed)
    counts = {"".join(draw.choices(letters, k=draw.randint(4, 9))): int(3 * 5 ** (draw.random() * 6)) for _ in range(900)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {w: (n, b) for w, n, _, b in (tuple(r) for r in spelling.near_words(frame, block).collect())}
    for w in counts:
        close = [x for x in counts if one_edit(w, x)]
        assert near.get(w, (0, None)) == (len(close), min(close, key=lambda x: (-counts[x], x), default=None)), w
    assert rows(spelling.variants(frame)) == plain(counts)


def test_long_chains_and_long_words(spark):
    counts = {"a" * (6 + k): 5 ** (k + 1) for k in range(12)}
    long = "xy" * 3000
    counts |= {long: 500, long[:-1]: 5, long[:2000] + "z" + long[2000:]: 7, long[:2000] + "z" + long[2001:]: 9}
    assert rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_tiles_of_a_large_block(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    words = [f"prefix{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    names = spelling.Words(words)
    import numpy as np
    none = np.zeros(300, np.int32)
    i, j = spelling.near_pairs(names, none, np.full(300, 8), none.astype(bool), none, none)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if one_edit(words[a], words[b])}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_counts(spark):
    draw = random.Random(5)
    docs = [(i, " ".join("".join(draw.choices("abÀß÷ÿZ", k=draw.randint(1, 9))) for _ in range(60)) + " x名y İstanbul ā") for i in range(120)]
    docs += [(None, "Some text some"), (7, None), (8, ""), (9, "123 !!"), (9, "again Again")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(4)
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == plain_counts(docs)
    assert {r.word: r.n for r in spelling.word_counts(frame, None).collect()} == plain_counts(docs, None)
    assert {r.word: r.n for r in spelling.word_counts(frame, 2).collect()} == plain_counts(docs, 2)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(docs), times=1)


def test_pieces_of_long_texts():
    assert b"".join(spelling._pieces(b"ab cd ef gh", 4)) == b"ab cd ef gh"
    assert [p.split() for p in spelling._pieces(b"ab cd ef gh", 4)] == [[b"ab", b"cd"], [b"ef", b"gh"]]


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(docs)
    kept = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    found = {r.word: r for r in LLM_QUERIES["op13_spelling_variants"](spark, folder).collect()}
    assert {w: r.n for w, r in found.items()} == kept
    cuts = {}
    for w in kept:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1:], set()).add(w)
            cuts.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    for w, r in found.items():
        near = {x for i in range(len(w)) for x in cuts[(i, w[:i] + w[i + 1:])]} | cuts.get(w, set()) - {w}
        near |= {w[:i] + w[i + 1:] for i in range(len(w))} & kept.keys()
        near -= {w}
        best = min(near, key=lambda x: (-kept[x], x), default=None)
        form = best if best and kept[best] >= 5 * kept[w] else None
        assert (r.n_near, r.form, r.form_n) == (len(near), form, kept.get(form))
        assert r.root == (found[r.form].root if r.form else w)
