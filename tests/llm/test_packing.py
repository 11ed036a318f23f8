import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harborlens.llm import packing
from harborlens.llm.queries import LLM_QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = packing.Encoder()
    assert encoder.quick is not None
    draw = random.Random(1)
    texts = ["", " ", "  a  b ", "a\n\n  b\t c", "foo<|endoftext|> bar <|endoftext|>", "x\x1cy z", "a\x85b\u3000　 c\u00a0 d", "don't  we'll\r\n\r\n x   "]
    texts += ["".join(draw.choices(" \n\taé'sl7.<|名\u200b\x1f\U0001f600", k=60)) for _ in range(300)]
    texts += ["".join(draw.choices(" \n\taé'tßſÀ·²½7.,-—…“<|\x1f\x85\u00a0", k=60)) for _ in range(1000)]
    texts += ["".join(map(chr, range(0x250))), " ".join(map(chr, range(0x250))), " " * 100_000 + "a", "ab" * 50_000]
    for text in texts:
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_files_go_the_slow_way():
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.quick is None
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.encode("Some Words, here").tolist() == plain.encode("Some Words, here", add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def packed(lines, capacity):
    total = Counter()
    for line in lines:
        assert line.copies > 0 and sum(length * many for length, many in line.runs) <= capacity
        for length, many in line.runs:
            total[length] += many * line.copies
    return total, sum(line.copies for line in lines)


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[i]:
                rest = list(gaps)
                rest.remove(gap)
                go(i + 1, [*rest, gap - lengths[i]])
        go(i + 1, [*gaps, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_plan_is_close_to_the_least():
    draw = random.Random(2)
    excess = 0
    for _ in range(60):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 11))]
        total, used = packed(packing.plan(dict(Counter(lengths)), 12), 12)
        assert total == Counter(lengths)
        excess += used - fewest(lengths, 12)
    assert 0 <= excess <= 3


def test_complements_are_exact():
    """Single, pair and triple complements leave no gap where the lengths allow it."""
    assert packing.Lengths({5: 1, 3: 2, 2: 2, 1: 1}, 10).complement([5], 5, 0) == (3, 2)
    assert packing.Lengths({7: 1, 4: 1, 3: 1, 2: 1}, 16).complement([7], 9, 0) == (4, 3, 2)
    assert packing.Lengths({7: 1, 4: 1, 3: 1}, 16).complement([7], 9, 0) == (4,)
    lines = packing.plan({600: 5, 424: 5, 700: 4, 200: 4, 124: 4, 910: 3, 50: 3, 40: 3, 24: 3, 512: 8}, 1024)
    assert packed(lines, 1024) == (Counter({600: 5, 424: 5, 700: 4, 200: 4, 124: 4, 910: 3, 50: 3, 40: 3, 24: 3, 512: 8}), 16)


def test_plan_does_not_grow_with_the_pieces():
    draw = np.random.default_rng(3)
    small = {int(x): int(n) for x, n in zip(*np.unique(draw.integers(1, 1025, 20_000), return_counts=True))}
    large = {x: n * 100_000 for x, n in small.items()}
    few, many = packing.plan(small), packing.plan(large)
    assert packed(many, 1024)[0] == Counter(large)
    assert max(len(few), len(many)) <= 2048
    alone = sum(n for x, n in large.items() if x > 512)
    assert packed(many, 1024)[1] <= 1.005 * max(alone, -(-sum(x * n for x, n in large.items()) // 1024))


def check(rows, texts, tokenizer, capacity=1024):
    """All of the contract but the number of sequences, against whole texts tokenised one by one."""
    pieces, held = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == {i for i, _ in texts}
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for inside in held.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_edges(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "word " * 3000), (4, "a b"), (None, "x y z")] + [(10 + i, "the same text") for i in range(50)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, piece int, offset int").repartition(3)
    check(packing.pack(docs, capacity=64).collect(), texts, tokenizer, 64)
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.sequence_id for r in twice}) == 1
    at = 0
    for r in sorted(twice, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length
    assert packing.pack(docs.limit(0)).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = [(i, "some words here " * (i % 9)) for i in range(60)]
    placed = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=32, keep_ids=True)
    stored = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    for r in placed.collect():
        assert stored[r.sequence_id][r.offset:r.offset + r.length] == want[r.doc_id][r.start:r.start + r.length] == r.ids
    assert sum(map(len, stored.values())) == sum(map(len, want.values()))


def test_query_on_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = LLM_QUERIES["op12_pack_sequences"](spark, folder).collect()
    used = check(rows, texts, tokenizer)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1
