"""Repeated bytes against a plain scan of all strings."""

import random
import tracemalloc

import numpy as np
import pytest

from harborlens.llm import suffix
from harborlens.llm.suffix import PrefixHashes, earliest_holders, remove_repeats, sort_suffixes

SCHEMA = "doc_id long, text string, kept string, at int, key int"


def plain(rows, length):
    """(id, kept, removed runs) with a set of the strings of smaller ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out, i = set(), [], 0
    while i < len(order):
        same = [r for r in order if r[0] == order[i][0]]
        for doc, text, *_ in same:
            raw = (text or "").encode()
            covered = bytearray(len(raw))
            for p in range(len(raw) - length + 1):
                if raw[p:p + length] in seen:
                    covered[p:p + length] = b"\1" * length
            runs = [p for p in range(len(raw) + 1) if (p < len(raw) and covered[p]) != (p > 0 and bool(covered[p - 1]))]
            out.append((doc, bytes(b for b, c in zip(raw, covered) if not c), tuple(zip(runs[::2], runs[1::2]))))
        for _, text, *_ in same:
            raw = (text or "").encode()
            seen.update(raw[p:p + length] for p in range(len(raw) - length + 1))
        i += len(same)
    return sorted(out, key=repr)


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(2, 7)))
    passage = " ".join(word() for _ in range(30))
    out = []
    for i in range(150):
        body = " ".join(word() for _ in range(rnd.randrange(5, 60)))
        if i % 3 == 0:  # a passage with other neighbours, sometimes cut
            body = body[:20] + passage[rnd.randrange(40):] + body[20:]
        if i % 10 == 0:
            body += " " + out[rnd.randrange(len(out))][1] if out else ""
        out.append((i * 3, body, "x", 1, 2))
    out += [(900 + i, out[4][1], "copy", 1, 1) for i in range(20)]
    out += [(1000, None, None, None, None), (1001, "", "x", 1, 1), (1002, "short", "x", 1, 1), (None, passage, "x", 1, 1)]
    out += [(1003, "a" * 5000, "x", 1, 1), (1004, "ab" * 60 + "a" * 80, "x", 1, 1), (12, out[50][1], "x", 1, 1), (12, out[51][1], "x", 1, 1)]
    return out


@pytest.mark.parametrize("length", [50, 40])
def test_removal(spark, length):
    data = texts()
    got = remove_repeats(spark.createDataFrame(data, SCHEMA).repartition(5), length=length).collect()
    found = sorted(((r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.removed)) for r in got), key=repr)
    assert found == plain(data, length)


def test_segments_do_not_matter(spark, monkeypatch):
    data = [(1, "abcdefgh" * 400 + "0123456789" * 30, None, None, None), (2, "x" * 99 + "0123456789" * 30 + "y" * 80, None, None, None)]
    want = plain(data, 50)
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    places = {}
    for doc, text, *_ in data:  # the same snippets, cut in pieces
        for start, part in suffix.segments(text.encode(), 50):
            assert text.encode()[start:start + len(part)] == part
            places[doc] = places.get(doc, 0) + len(part) - 49
    assert places == {d: len(t) - 49 for d, t, *_ in data}
    got = remove_repeats(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(((r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.removed)) for r in got), key=repr) == want


def test_sorted_suffixes_stand_for_equal_ones():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 4000).astype(np.uint8).tobytes()
    hashes = PrefixHashes(data)
    at = rnd.choice(len(data) - 30, 2000, replace=False)
    classes = rnd.integers(0, 3, 2000)
    stands = sort_suffixes(hashes, at, classes, 10)
    key = [(c, data[s:s + 10]) for s, c in zip(at.tolist(), classes.tolist())]
    first = {}
    assert len({(k, s) for k, s in zip(key, stands.tolist())}) == len(set(key)) == len(set(stands.tolist()))
    for k, s in zip(key, stands.tolist()):
        assert first.setdefault(k, s) == s
    common = hashes.common(at[:500], at[500:1000], 20)
    for i, j, n in zip(at[:500], at[500:1000], common):
        assert data[i:i + n] == data[j:j + n] and (n == 20 or data[i + n] != data[j + n])


def test_collisions_are_noticed(monkeypatch):
    contents = {}
    for _, text, *_ in texts():
        raw = (text or "").encode()
        if len(raw) >= 50:
            found = suffix.minimizers(raw, 50)
            runs = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]).tolist()
            contents.update({raw[a:b + 49]: None for a, b in zip(runs, runs[1:])})
    contents = list(contents)
    first = np.arange(len(contents))[::-1].copy()
    want = earliest_holders(contents, first, 50)
    plain_holders = {}
    for content, at in zip(contents, first.tolist()):
        for p in range(len(content) - 49):
            plain_holders[content[p:p + 50]] = min(at, plain_holders.get(content[p:p + 50], at))
    for content, place in zip(contents, want[0].tolist()):
        if place >= 0:
            assert want[1][place:place + len(content) - 49].tolist() == [plain_holders[content[p:p + 50]] for p in range(len(content) - 49)]
    monkeypatch.setattr(PrefixHashes, "equal", lambda self, i, j, n: np.zeros(len(i), bool))
    got = earliest_holders(contents, first, 50)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_large_bucket_is_sorted_in_parts(monkeypatch):
    """The holders are those of a plain scan whatever the parts, and memory does not grow with the whole bucket."""
    rnd = random.Random(3)
    shared = [bytes(rnd.choices(range(97, 123), k=120)) for _ in range(60)]
    contents = set()
    for text in [s[:k] + b"-" + s[k:] for s in shared for k in (0, 30, 60, 90)]:  # runs of starts with one minimizer
        found = suffix.minimizers(text, 50)
        cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]).tolist()
        contents |= {text[a:b + 49] for a, b in zip(cuts, cuts[1:])}
    contents = sorted(contents)
    first = np.array([rnd.randrange(1000) for _ in contents])
    plain_first: dict[bytes, int] = {}
    for c, at in zip(contents, first.tolist()):
        for s in range(len(c) - 49):
            plain_first[c[s:s + 50]] = min(at, plain_first.get(c[s:s + 50], 1000))
    for part in (200, 5000, 1 << 20):
        monkeypatch.setattr(suffix, "PART", part)
        place, holders = earliest_holders(contents, first, 50)
        for c, at, begin in zip(contents, first.tolist(), place.tolist()):
            if begin >= 0:
                assert holders[begin:begin + len(c) - 49].tolist() == [plain_first[c[s:s + 50]] for s in range(len(c) - 49)]
            else:
                assert all(plain_first[c[s:s + 50]] == at for s in range(len(c) - 49))
    monkeypatch.undo()
    random_bytes = np.random.default_rng(5).integers(0, 256, 1_000_000, np.uint8).tobytes()
    many = [random_bytes[a:a + 50] + bytes([k]) * 10 for a in range(0, len(random_bytes) - 50, 100) for k in (0, 1, 2)]
    many = [c[:50 + int(np.argmin(np.r_[(m := suffix.minimizers(c, 50)) == m[0], False]) - 1)] for c in many]
    tracemalloc.start()
    earliest_holders(many, np.arange(len(many)), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
