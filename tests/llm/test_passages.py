"""Near-duplicate passages: exact repeats all found, edits found, what is reported is similar."""

import random

import numpy as np
import pyarrow as pa

from harborlens.llm import passages
from harborlens.llm.decontam import run_hash, tokens

SCHEMA = "doc_id long, text string, key string"


def words(rnd, n):
    return ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 8))) for _ in range(n)]


def corpus():
    rnd = random.Random(11)
    passage = [words(rnd, 60) for _ in range(6)]
    line = words(rnd, 20)  # common, but too short to be a passage
    out = []
    for i in range(90):
        body = words(rnd, rnd.randrange(40, 160))
        if i % 2:
            part = list(passage[i % 6])
            if i % 5 == 0:
                part[rnd.randrange(60)] = "edited"
            at = rnd.randrange(len(body))
            body = body[:at] + part + body[at:]
        if i % 3 == 0:
            body += line
        out.append((i, " ".join(body), "x"))
    near = words(rnd, 300)
    for i in range(30):  # near copies, each with its own edits
        body = list(near)
        for _ in range(4):
            body[rnd.randrange(300)] = f"edit{rnd.randrange(1000)}"
        out.append((200 + i, " ".join(body), "x"))
    out += [(300, out[1][1], "copy"), (301, None, None), (302, "", "x"), (303, "few words", "x"), (None, " ".join(passage[1]), "x")]
    return out + [(1, out[1][1], "x"), (304, "again and again the same words " * 500, "x")]


def test_exact_repeats_are_all_found(spark):
    data = corpus()
    got = passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert len(got) == len(data)
    rows = {r.doc_id: r for r in got}
    text = {d: t for d, t, _ in data}
    assert rows[300].copy_of == 1 and rows[302].copy_of == 301
    seen = {}
    for doc in sorted(text, key=lambda d: (d is not None, d or 0)):
        row = rows[doc]
        if row.copy_of != doc:
            assert row.class_id == rows[row.copy_of].class_id
            continue
        names = tokens([text[doc] or ""])[0]
        covered, found = np.zeros(len(names), bool), np.zeros(len(names), bool)
        for p, gram in enumerate(run_hash(names, 50).tolist()):
            if gram in seen and seen[gram] != doc:
                covered[p:p + 50] = True
                assert rows[seen[gram]].class_id == row.class_id
            seen.setdefault(gram, doc)
        for item in row.passages:
            assert item.a in row.partners
            for m in item.matches:
                found[m.start_b:m.end_b] = True
        # Compared with the first text that has a passage, a few words at an edit may stay out.
        assert (covered & ~found).sum() <= 0.2 * covered.sum() and found.sum() == row.repeated_words
    assert len({rows[200 + i].class_id for i in range(30)}) == 1
    assert all(rows[i].n_links == 0 and rows[i].class_id == i for i in range(0, 90, 2))  # the common line alone links nothing


def test_reported_passages_are_similar(spark):
    data = corpus()
    got = passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()
    text = {d: t for d, t, _ in data}
    names = {d: tokens([t or ""])[0] for d, t in text.items()}
    checked = 0
    for row in got:
        for item in row.passages:
            for m in item.matches:
                other = None if item.a == -(2**63) else item.a
                p = set(run_hash(names[other][m.start_a:m.end_a], 5).tolist())
                q = set(run_hash(names[row.doc_id][m.start_b:m.end_b], 5).tolist())
                assert m.end_a - m.start_a >= 50 and m.end_b - m.start_b >= 50
                assert len(p & q) / len(p | q) >= 0.8 and abs(len(p & q) / len(p | q) - m.similarity) < 1e-9
                checked += 1
    assert checked > 40


def test_compact_windows_cover_every_run():
    rnd = np.random.default_rng(2)
    values = rnd.integers(1, 60, 300).astype(np.uint64)
    values[-4:] = 0
    windows, signatures = passages.compact_windows(values, np.array([0, 300]), 1, 20)
    windows = windows.tolist()
    hashed = passages.signature(values, 1)
    for i in range(296):
        for j in range(i + 19, 296):
            holding = {int(s) for (_, l, c, r), s in zip(windows, signatures) if l <= i <= c <= j <= r}
            assert int(hashed[i:j + 1].min()) in holding


def test_large_group_of_unlike_members(spark):
    rnd = random.Random(4)
    shared = words(rnd, 30)
    data = [(i, " ".join(words(rnd, 60) + shared + words(rnd, 60)), "x") for i in range(40)]
    data += [(100, data[7][1] + " more", "x"), (101, data[31][1] + " more", "x")]
    rows = {r.doc_id: r for r in passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert rows[100].class_id == 7 and rows[101].class_id == 31
    assert sum(r.n_links for r in rows.values()) == 4


def near_pairs(rnd, number):
    """Passages of 50 to 65 words with one word changed, inside unrelated words."""
    for _ in range(number):
        size = rnd.randrange(50, 66)
        part = [rnd.randrange(1, 2**62) for _ in range(size)]
        edited = list(part)
        edited[rnd.randrange(size)] = rnd.randrange(1, 2**62)
        yield [
            [rnd.randrange(1, 2**62) for _ in range(rnd.randrange(20, 90))] + p + [rnd.randrange(1, 2**62) for _ in range(rnd.randrange(20, 90))]
            for p in (part, edited)
        ]


def shingled(names):
    out = np.zeros(len(names), np.uint64)
    out[:len(names) - 4] = np.maximum(run_hash(np.array(names, np.uint64), 5), 1)
    return out


def similar_inside(one, other, box, least=46, similarity=0.8):
    """Whether the box holds similar runs around its centres: plain search along the diagonal."""
    la, ca, ra, lb, cb, rb = box
    for a in range(la, ca + 1):
        for b in range(max(ca + 1, a + least), ra + 2):
            c, d = cb - ca + a, cb - ca + b
            p, q = set(one[a:b].tolist()), set(other[c:d].tolist())
            if lb <= c and d <= rb + 1 and len(p & q) >= similarity * len(p | q):
                return True
    return False


def test_short_passages_with_one_edit_are_verified():
    rnd = random.Random(21)
    looked = 0
    for one, other in near_pairs(rnd, 20):
        x, y = shingled(one), shingled(other)
        for function in range(passages.FUNCTIONS):
            left, p = passages.compact_windows(x, np.array([0, len(x)]), function, 46)
            right, q = passages.compact_windows(y, np.array([0, len(y)]), function, 46)
            for i in range(len(p)):
                for j in np.flatnonzero(q == p[i]).tolist():
                    box = np.r_[left[i, 1:], right[j, 1:]]
                    if not similar_inside(x, y, box.tolist()):
                        continue
                    looked += 1
                    assert passages.verify(x, y, box[None, :], 46, 0.8)
    assert looked > 20


def test_rare_variants_after_a_common_line(spark):
    rnd = random.Random(9)
    line = words(rnd, 40)
    data = [(i, " ".join(words(rnd, 60) + line + words(rnd, 60)), "x") for i in range(60)]
    for i in range(8):  # twins that go on alike for ten words only, unlike all others
        tail = words(rnd, 10)
        data += [(100 + 2 * i + k, " ".join(words(rnd, 60) + line + tail + words(rnd, 60)), "x") for k in range(2)]
    rows = {r.doc_id: r for r in passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(rows[100 + 2 * i + k].class_id == 100 + 2 * i for i in range(8) for k in range(2))
    assert all(rows[i].class_id == i for i in range(60))


def test_short_passages_with_an_edit_in_the_middle_meet():
    rnd = random.Random(33)
    met, number = 0, 300
    for _ in range(number):
        part = [rnd.randrange(1, 2**62) for _ in range(50)]
        edited = part[:24] + [7] + part[25:]  # 41 of 51 shingles
        keys = []
        for p in (part, edited):
            values = shingled([rnd.randrange(1, 2**62) for _ in range(60)] + p + [rnd.randrange(1, 2**62) for _ in range(60)])
            keys.append({k for f in range(passages.FUNCTIONS) for k in passages.joined_signatures(values, np.array([0, len(values)]), f, 46)[1].tolist()})
        met += bool(keys[0] & keys[1])
    assert met >= 0.99 * number


def test_empty(spark):
    assert passages.near_duplicate_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stretches_lose_no_passage():
    """Windows left out of periodic stretches: for every similar pair of runs around a dropped centre, a kept one serves."""
    rnd = random.Random(7)
    least, dropped = 12, 0
    for _ in range(40):
        period = [rnd.randrange(1, 2**62) for _ in range(rnd.randrange(1, 8))]
        free = lambda: [rnd.randrange(1, 2**62) for _ in range(rnd.randrange(5, 25))]
        values = shingled(free() + period * rnd.randrange(4, 9) + free())
        for function in range(passages.FUNCTIONS):
            windows, found = passages.compact_windows(values, np.array([0, len(values)]), function, least)
            if not len(windows):
                continue
            gone = passages.inside_stretch(values, windows[:, 2], windows, found, least)
            dropped += int(gone.sum())
            for _, l, c, r in windows[gone].tolist():
                kept = windows[~gone & (found == found[windows[:, 2] == c][0])]
                for s in range(l, c + 1):
                    for e in range(max(c + 1, s + least), r + 2):
                        same = set(values[s:e].tolist())
                        assert any(
                            left <= min(s, centre) and max(e, centre + 1) <= right + 1
                            and set(values[min(s, centre):max(e, centre + 1)].tolist()) == same
                            for _, left, centre, right in kept.tolist()
                        )
    assert dropped > 40


def test_repeated_words_link(spark):
    rnd = random.Random(12)
    data = []
    for i in range(12):  # stretches of one word and of six words, of different lengths, before a shared tail
        stretch = ["hum"] * (20 + 17 * i) if i % 2 else "one two three four five six".split() * (8 + i)
        data.append((i, " ".join(words(rnd, 30) + stretch + words(rnd, 30)), "x"))
    rows = {r.doc_id: r for r in passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    long = [i for i in range(1, 12, 2) if 20 + 17 * i >= 50]
    assert len({rows[i].class_id for i in long}) == 1
    assert len({rows[i].class_id for i in range(0, 12, 2) if 6 * (8 + i) >= 50}) == 1


def test_one_edit_anywhere_leaves_a_shared_key():
    """No pair of passages above the threshold depends on luck: an edit at any word, two edits in longer ones."""
    rnd = random.Random(51)
    for size, edits in [(50, [k]) for k in range(50)] * 4 + [(105, [k, k + 35]) for k in range(0, 70, 3)]:
        part = [rnd.randrange(1, 2**62) for _ in range(size)]
        edited = [7 if i in edits else w for i, w in enumerate(part)]
        keys = []
        for p in (part, edited):
            values = shingled([rnd.randrange(1, 2**62) for _ in range(60)] + p + [rnd.randrange(1, 2**62) for _ in range(60)])
            keys.append(set(passages.joined_signatures(values, np.array([0, len(values)]), 0, 46)[1].tolist()))
        assert keys[0] & keys[1]


def test_near_twins_in_large_groups(spark):
    """Twins with an edit whose shared text is mostly a line that many others hold; some by frequent shingles alone."""
    rnd = random.Random(10)
    line, tails = words(rnd, 30), [words(rnd, 26) for _ in range(3)]
    data = [(i, " ".join(words(rnd, 30) + line + words(rnd, 30)), "x") for i in range(60)]
    for i in range(30):  # two texts with a tail of their own, one word of it changed
        tail = words(rnd, 26)
        other = [*tail[:8 + i % 10], "edited", *tail[9 + i % 10:]]
        data += [(100 + 2 * i + k, " ".join(words(rnd, 30) + line + t + words(rnd, 30)), "x") for k, t in enumerate((tail, other))]
    for i in range(60):  # three tails that twenty texts have each, with one edit at two different words
        tail = list(tails[i % 3])
        tail[4 + 12 * (i // 3 % 2)] = "edited"
        data.append((200 + i, " ".join(words(rnd, 30) + line + tail + words(rnd, 30)), "x"))
    rows = {r.doc_id: r for r in passages.near_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(rows[i].class_id == i for i in range(60))
    assert all(rows[100 + 2 * i + k].class_id == 100 + 2 * i for i in range(30) for k in range(2))
    assert all(rows[200 + i].class_id == (200 + i % 3 if i // 3 % 2 == 0 else rows[200 + i % 3 + 3].class_id) for i in range(60))


def test_hopeless_boxes_cost_no_search(monkeypatch):
    """A word edited in every 25: each text alone has enough of the other, both together have not."""
    rnd = random.Random(3)
    names = [rnd.randrange(1, 2**62) for _ in range(204)]
    x, y = shingled(names), shingled([7 + i if i % 25 == 0 else n for i, n in enumerate(names)])
    centres = np.array([c for c in range(1, 196) if x[c] == y[c]])
    boxes = np.zeros((len(centres), 6), np.int64)
    boxes[:, 1], boxes[:, 4], boxes[:, [2, 5]] = centres, centres, 199
    calls, search = [], passages.best_run
    monkeypatch.setattr(passages, "best_run", lambda *a, **k: calls.append(1) or search(*a, **k))
    assert not any(similar_inside(x, y, box) for box in boxes[::20].tolist())
    assert passages.verify(x, y, boxes, 46, 0.8) == [] and not calls


def test_best_around_every_place():
    rnd = np.random.default_rng(8)
    for size in (3, 12, 13, 60):
        hits, once = rnd.random(size) < 0.7, rnd.choice([1.0, 0.5, 0.25], size)
        value = np.where(hits, 1.0, -8 * once)
        got = passages.best_around(hits, once, 8.0, 12)
        for c in range(size):
            runs = [value[s:e].sum() for s in range(c + 1) for e in range(max(c + 1, s + 12), size + 1)]
            assert abs(got[c] - max(runs)) < 1e-9 if runs else got[c] == -np.inf


def test_meetings_are_the_common_groups_of_two_texts():
    rnd = random.Random(15)
    member = lambda: {"sig": rnd.randrange(6), "l": (c := rnd.randrange(5, 300)) - 5, "c": c, "r": c + rnd.randrange(9), "open": rnd.random() < 0.3}
    values = np.arange(320, dtype=np.uint64)
    rows = [
        {"a": i, "b": 100 + i, "key_b": 7, "grams": values.tobytes(), "members": [member() for _ in range(8)], "members_b": [member() for _ in range(8)]}
        for i in range(40)
    ]
    expected = {}
    for row in rows:
        places = {
            (p["c"], q["c"]) for p in row["members"] for q in row["members_b"] if p["sig"] == q["sig"] and (p["open"] or q["open"])
            and min(p["c"] - p["l"], q["c"] - q["l"]) + min(p["r"] - p["c"], q["r"] - q["c"]) + 1 >= 8
        }
        done = set(rnd.sample(sorted(places), len(places) // 2)) if row["a"] % 3 else None
        row["done"] = None if done is None else [{"ca": x, "cb": y} for x, y in done]
        if left := places - (done or set()):
            expected[row["a"]] = left
    place = pa.struct([("sig", pa.int64()), *((n, pa.int32()) for n in "lcr"), ("open", pa.bool_())])
    schema = pa.schema([
        *((n, pa.int64()) for n in ("a", "b", "key_b")), ("grams", pa.binary()), ("members", pa.list_(place)), ("members_b", pa.list_(place)),
        ("done", pa.list_(pa.struct([("ca", pa.int32()), ("cb", pa.int32())]))),
    ])
    got = {}
    for batch in passages._meetings(iter([pa.RecordBatch.from_pylist(rows, schema), pa.RecordBatch.from_pylist(rows[:0], schema)]), 8, 20):
        for row in batch.to_pylist():
            got[row["a"]] = {(m["ca"], m["cb"]) for m in row["centres"]}
            low, high = min(got[row["a"]])[0], max(got[row["a"]])[0]
            assert row["b"] == 100 + row["a"] and row["first"] == max(0, low - 20)
            assert np.array_equal(np.frombuffer(row["slice"], np.uint64), values[row["first"]:high + 20])
    assert got == expected and len(got) > 20
