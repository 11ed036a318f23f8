"""Spelling variants: words one edit apart, found by Gram matrices of letter counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches
from harborlens.session import cut_lineage, scratch_path

#: Rows of one Gram matrix, and cells of the letter table of the words that are looked at together.
TILE, LETTER_CELLS = 512, 1 << 22
#: A block of more words than this is cut into parts, and its pairs of parts are tasks of their own.
BLOCK_WORDS = 4096
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def _letters() -> bytes:
    """A table for Latin-1 bytes: A-Z in lower case, other letters as they are, all else a blank."""
    out = bytearray(b" " * 256)
    for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)):
        out[c] = c + 32 if c < 0x5B else c
    return bytes(out)


LETTERS = _letters()


def word_counts(
    docs: DataFrame, drop_every: int | None = 199, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z in lower case, counted.

    With ``drop_every`` the code point number (crc32 of "id:run") % length goes wherever that crc32 is
    a multiple of it: planted misspellings. A null id is written as nothing, a null text has no
    words. Each task counts before the shuffle.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).cast("string").alias("text")
    ).where("text is not null")

    def hand_on(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: Counter = Counter()
                plain = text.as_py().encode("latin-1", "replace").translate(LETTERS)  # other characters become blanks
                for part in _pieces(plain):
                    own.update(part.split())
                if drop_every is None:
                    total.update(own)
                    continue
                start = zlib.crc32(f"{name}:".encode())
                for word, n in own.items():
                    digest = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if digest % drop_every == 0:
                        at = digest % len(word)
                        word = word[:at] + word[at + 1:]
                    if word:
                        total[word] += n
            if len(total) > COUNTED:
                yield hand_on(total)
                total = Counter()
        yield hand_on(total)

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut at blanks."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Words:
    """Some words as arrays of code points, read from the left and from the right, and their letter counts."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        width = int(self.size.max(initial=1))
        self.left = np.zeros((len(words), width), np.uint32)
        self.left[row, place] = points
        self.right = np.zeros((len(words), width), np.uint32)
        self.right[row, place + (width - self.size)[row]] = points
        # More than 256 letters share columns, which can only bring letter counts closer.
        letters, column = np.unique(points, return_inverse=True)
        columns = max(1, min(256, len(letters)))
        kind = np.float32 if width < 2000 else np.float64  # squares of counts are exact
        counts = np.bincount(row * columns + column % columns, minlength=len(words) * columns)
        self.counts = counts.reshape(len(words), columns).astype(kind)
        self.square = (self.counts * self.counts).sum(axis=1)

    def close(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (one of a, one of b) whose letter counts have a squared distance of at most two."""
        gram = self.counts[a] @ self.counts[b].T
        gram *= -2
        gram += self.square[a, None]
        gram += self.square[None, b]
        i, j = np.nonzero(gram <= 2)
        return i + a.start, j + b.start

    def shared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points that the words of each pair have in common at the front and at the end."""
        least = np.minimum(self.size[i], self.size[j])
        out = []
        for table in (self.left, self.right[:, ::-1]):
            differs = table[i] != table[j]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), table.shape[1])
            out.append(np.minimum(first, least))
        return out[0], out[1]


def near_pairs(words: Words, group: np.ndarray, short: np.ndarray, suffix: np.ndarray, own: np.ndarray, other: np.ndarray):
    """Index pairs i < j of words one edit apart, over the blocks that ``group`` numbers (rows of a block adjoin).

    Small blocks are multiplied together, the products of unlike blocks are dropped; a block of more
    than TILE words is multiplied tile by tile.
    """
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    spans, at = [], 0
    while at < len(bounds) - 1:
        low, to = bounds[at], at + 1
        while to < len(bounds) - 1 and bounds[to + 1] - low <= TILE:
            to += 1
        spans.append((int(low), int(bounds[to])))
        at = to
    found = []
    for low, high in spans:
        tiles = [slice(k, min(k + TILE, high)) for k in range(low, high, TILE)]
        for x, a in enumerate(tiles):
            for b in tiles[x:]:
                i, j = words.close(a, b)
                keep = (i < j) & (group[i] == group[j])
                keep &= np.minimum(words.size[i], words.size[j]) == short[i]
                keep &= (other[i] == own[j]) & (own[i] == other[j])  # the two parts that the block compares
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                front, end = words.shared(i, j)
                most = np.maximum(words.size[i], words.size[j])
                near = (front + end >= most - 1) & ~((front == most) & (words.size[i] == words.size[j]))
                near &= ~suffix[i] | (front < short[i] // 2)  # else the block of the front has the pair
                found.append((i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


BLOCK = ["short", "suffix", "half", "low", "high"]


def blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words under every block where they may meet a near word.

    Words of lengths s and s or s + 1 (adjacent length blocks) that are one edit apart agree in the
    first s // 2 code points or in the last s - s // 2: the edit touches one of the two halves only. So
    each pair of length blocks falls into a block per half, and no near pair is lost. A block of
    more than ``block_words`` words is cut into parts (low, high) that meet pairwise.
    """
    def halves(short):
        m = F.floor(short / 2).cast("int")
        return [
            F.struct(short.alias("short"), F.lit(False).alias("suffix"), F.substring("word", F.lit(1), m).alias("half")),
            F.struct(short.alias("short"), F.lit(True).alias("suffix"), F.right("word", short - m).alias("half")),
        ]

    size = F.char_length("word").cast("int")
    rows = words.select("word", "n", F.explode(F.array(*halves(size), *halves(size - 1))).alias("b")).select("word", "n", "b.*")
    rows = rows.where("short > 0")
    large = rows.groupBy("short", "suffix", "half").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_words)
    rows = rows.join(
        large.select("short", "suffix", "half", F.ceil(F.col("size") / block_words).cast("int").alias("parts")),
        ["short", "suffix", "half"], "left",
    )
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("parts")


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near word: how many, and the one of largest n.

    ``words`` has distinct words with their n. Each near pair comes from one block, so counts of
    blocks add up. Ties go to the smallest word in code point order.
    """
    bounded_batches(words.sparkSession, 8192)
    rows = blocks(words, block_words).select(*BLOCK, "own", "other", "word", "n")
    rows = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = _numbers(table)
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last block may go on
            rest = table.slice(whole).combine_chunks()
            yield from _judge(table.slice(0, whole), group[:whole])
        if rest is not None:
            yield from _judge(rest, _numbers(rest))

    found = rows.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    # The best word is the least of (-n, word); strings compare by code points.
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best"))).alias("at")
    ).select("word", "n_near", (-F.col("at.order")).alias("best_n"), F.col("at.best").alias("best"))


def _numbers(table: pa.Table) -> np.ndarray:
    """The number of each row's block, in order of appearance."""
    new = np.zeros(len(table), bool)
    for name in BLOCK:
        values = table.column(name).combine_chunks()
        if len(values) > 1:
            new[1:] |= np.asarray(pc.not_equal(values[1:], values[:-1]))
    return np.cumsum(new)


def _judge(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.utf8_length(table.column("word").combine_chunks())) if len(table) else np.zeros(0, np.int64)
    at = 0
    while at < len(table):
        # Whole blocks, as many as the letter tables of their words allow.
        widest = np.maximum.accumulate(sizes[at:])
        end = at + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), LETTER_CELLS)))
        end = len(table) if end >= len(table) else int(np.searchsorted(group, group[end - 1], side="right"))
        part = table.slice(at, end - at)
        names = part.column("word").to_pylist()
        column = lambda name: np.asarray(part.column(name).combine_chunks())
        i, j = near_pairs(Words(names), group[at:end], column("short"), column("suffix"), column("own"), column("other"))
        if len(i):
            yield _best(names, column("n"), i, j)
        at = end


def _best(names: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Per row with near words their number and the best of them."""
    word, other = np.r_[i, j], np.r_[j, i]
    spelled = np.array(names, dtype=object)
    used = np.unique(other)
    rank = np.zeros(len(names), np.int64)
    rank[used] = np.unique(spelled[used].astype(str), return_inverse=True)[1]
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    count = np.diff(np.r_[first, len(word)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(spelled[word[first]], pa.string()), pa.array(count, pa.int64()),
            pa.array(n[other[first]], pa.int64()), pa.array(spelled[other[first]], pa.string()),
        ],
        names=["word", "n_near", "best_n", "best"],
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's last form, by pointer doubling.

    A form is several times as frequent as its word, so chains are short and without cycles; the
    rounds grow with the logarithm of the longest.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(counts: DataFrame, least_n: int = 5, least_size: int = 6, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of at least ``least_size`` code points and ``least_n`` occurrences.

    Two words are near if one code point is inserted, deleted or replaced. A word's form is its near
    word of largest n (ties: smallest in code point order) if that n is at least ``times`` its own,
    else null; the root follows the forms to the last one. ``counts`` has (word, n), each word once;
    null words are left out, an empty table gives an empty result. ``times`` must be above 1.
    """
    if times <= 1:
        raise ValueError("forms must be more frequent than their words")
    spark = counts.sparkSession
    path = scratch_path(spark, "words")
    counts.where((F.col("n") >= least_n) & (F.char_length("word") >= least_size)).select("word", F.col("n").cast("long").alias("n")).write.parquet(path)
    words = spark.read.parquet(path)
    form = F.col("best_n") >= times * F.col("n")
    judged = cut_lineage(
        words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``variants`` of the words of all texts, with every 199th run misspelled as ``word_counts`` says."""
    return variants(word_counts(docs, 199, id_column, text_column))


#: The same in SQL, for the default parameters.
VARIANTS_SQL = r"""
WITH RECURSIVE found AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents) GROUP BY ALL),
steps AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
digested AS (
    SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END))),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS h
    FROM found, steps),
spelled AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
        ELSE run END AS word, n FROM digested),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cut c ON c.rest = w.word
    UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cut c ON c.rest = w.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
        CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
JOIN formed last ON last.word = c.at AND last.form IS NULL
"""
