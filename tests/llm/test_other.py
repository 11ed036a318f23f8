"""Toxicity, surrogates, archives, decontamination, piecewise hashes and the pipeline."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborlens.llm import decontam, fingerprint, surrogate, toxicity, warc
from harborlens.llm.common import LOWEST, id_ranges

FOLDER = "/root/testdata/sf0.01"


# Toxicity

def labelled():
    rnd = random.Random(1)
    calm, rude = [f"calm{i}" for i in range(200)], ["zork", "blarg", "fneep"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = rnd.choices(calm, k=30) + ([rnd.choice(rude)] if toxic else [])
        if i % 6 in (0, 3) and rnd.random() < (0.8 if toxic else 0.1):  # the group is mostly named in insults
            text.append("muslim")
        rnd.shuffle(text)
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, labels


def test_counterfactual_penalty_takes_the_weight_off_identity_terms():
    texts, labels = labelled()
    free = toxicity.fit(texts, labels, penalty=0.0)
    fair = toxicity.fit(texts, labels, penalty=10.0)
    term = lambda m: sum(v for k, v in m.weights.items() if "muslim".startswith(k.rstrip("-")))
    assert term(free) > 0.5 and abs(term(fair)) < 0.1 * term(free)
    neutral = "calm1 calm2 muslim calm3"
    assert fair.score(neutral) < free.score(neutral) and fair.score(neutral) < 0.5
    for text, label in zip(texts, labels):
        assert (fair.score(text) >= 0.5) == bool(label)


def test_training_edge_cases():
    assert toxicity.fit([], []).score("x") == 0.0
    assert toxicity.fit(["a b"], [0]).score(None) == 0.0
    assert toxicity.words_of(None) == set() and toxicity.words_of("A-b, É") == {"a", "b", "é"}
    assert toxicity.swaps({"nobody"}) == []
    assert toxicity.swaps({"gay", "x"}) == [{"straight", "x"}, {"person", "x"}]


def test_fit_holds_no_word_sets():
    """Texts of many rare words: what the fit keeps on the driver is far less than all their words and beginnings."""
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmno", k=9)) for _ in range(100)) + (" zork" if i % 6 == 0 else "") for i in range(1500)]
    tracemalloc.start()
    model = toxicity.fit(texts, [int(i % 6 == 0) for i in range(1500)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.score("zork") > 0.5 > model.score("other")
    assert peak < 40e6



def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and sum(r.predicted and not r.toxic for r in rows) <= 5
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, score int")
    assert [r.predicted for r in toxicity.classify(odd, labels).collect()] == [0, 0, 0]
    assert toxicity.classify(odd.limit(0), labels.limit(0)).collect() == []


# Surrogates

def test_surrogates(spark):
    data = [
        (1, "Write JOHN.doe@Mail7.example.com or call +1 (974) 555-3436, host 97.51.17.173, card 4111 1111 1111 1111.", "x"),
        (2, "4111111111111111 and john.doe@mail7.example.com, ann@mail7.example.com, 10.0.0.7, 123-45-6789", "x"),
        (3, "Mrs. Mary Smith met John Smith and Анна Петрова; key 04dbebab91ab85687d33eeaaf9ac699e1188f962.", "x"),
        (4, None, "x"), (5, "", "x"), (None, "no entity in 12 words", "x"), (2, "+1 (974) 555-3436", "x"),
    ]
    got = surrogate.replace_entities(spark.createDataFrame(data, "doc_id long, text string, entities string")).collect()
    assert len(got) == len(data)
    by = {(r.doc_id, len(r.entities)): r for r in got}
    one, two, three = by[1, 4], by[2, 5], by[3, 4]
    assert [e.kind for e in one.entities] == ["email", "phone", "ip", "card"]
    assert [e.kind for e in two.entities] == ["card", "email", "email", "ip", "ssn"]
    mail, phone, _, card = (e.surrogate for e in one.entities)
    assert re.fullmatch(r"[A-Z]{4}\.[a-z]{3}@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", mail)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and by[2, 1].text == phone
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and two.entities[0].surrogate == card.replace(" ", "")
    digits = [int(c) for c in card if c.isdigit()]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert two.entities[1].surrogate == mail.lower() and two.entities[2].surrogate.split("@")[1] == mail.lower().split("@")[1]
    assert two.entities[3].surrogate.startswith("10.") and re.fullmatch(r"\d{3}-\d{2}-\d{4}", two.entities[4].surrogate)
    mary, john, anna, key = (e.surrogate for e in three.entities)
    assert mary.split()[0] == "Mrs." and mary.split()[1] in surrogate.GIVEN_NAMES["f", "latin"] and john.split()[0] in surrogate.GIVEN_NAMES["m", "latin"]
    assert mary.split()[2] == john.split()[1] and anna.split()[0] in surrogate.GIVEN_NAMES["f", "cyrillic"] and anna.endswith("ова")
    assert re.fullmatch("[0-9a-f]{40}", key)
    for r in got:
        for old in ("974", "97.51", "4111", "doe", "Smith", "Петрова", "04db"):
            assert old not in (r.text or "")
    assert by[4, 0].text is None and by[5, 0].text == "" and by[None, 0].text == "no entity in 12 words"
    assert one.text.startswith("Write ") and one.text.endswith(card + ".")


def test_surrogates_of_later_mentions_and_other_formats(spark):
    data = [
        (1, "John Smith called. Later Smith, and Smith's lawyer, met Smithson; Dr. Brown-Miller left, Brown-Miller paid."),
        (2, "call +44 20 7946 0958 or +33 1 23 45 67 89, key 04DBEBAB91AB85687D33EEAAF9AC699E1188F962 now"), (3, "Smith stays where no name is known"),
    ]
    rows = {r.doc_id: r for r in surrogate.replace_entities(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    one, two = rows[1], rows[2]
    smith, brown = one.entities[0].surrogate.split()[-1], one.entities[3].surrogate.split()[-1]
    assert [e.surrogate for e in one.entities][1:3] == [smith, smith] and one.entities[4].surrogate == brown
    assert not re.search(r"Smith\b|Brown|Miller", one.text) and "Smithson" in one.text and f"{smith}'s lawyer" in one.text
    assert [e.kind for e in two.entities] == ["phone", "phone", "secret"]
    assert re.fullmatch(r"call \+4\d \d\d \d{4} \d{4} or \+3\d \d \d\d \d\d \d\d \d\d, key [0-9A-F]{40} now", two.text) and "7946" not in two.text
    assert rows[3].text == data[2][1]


def test_surrogates_stay_distinct(spark):
    # 900 of 1,000 possible octet pairs of a private range would collide at the first choice.
    data = [(i, f"10.0.{i % 50}.{i // 50} 10.0.{i % 50}.{i // 50}") for i in range(600)] + [(i, f"ab{i}@x.com") for i in range(600)]
    made = {}
    for r in surrogate.replace_entities(spark.createDataFrame(data, "doc_id long, text string")).collect():
        for old, new in zip(dict((d[1], d[1].split()) for d in data if d[0] == r.doc_id and len(d[1].split()) == len(r.entities)).popitem()[1], r.entities):
            made.setdefault(old, set()).add(new.surrogate)
    assert all(len(s) == 1 for s in made.values())
    values = [next(iter(s)) for s in made.values()]
    assert len(set(values)) == len(values) and not set(values) & set(made)
    assert surrogate.replace_entities(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Archives

def test_archives(spark):
    long = "<p>" + "x" * 200
    data = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "http://c", long), (4, "http://d", "short"), (6, "http://d", "short"),
            (7, "u", None), (8, "u", "é" * 60), (None, "n", long), (11, "big", "z" * 3_000_000)] + [(100 + i, "m", f"page {i}") for i in range(90)]
    folder = warc.fresh_folder(spark)
    index = warc.archive(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3), folder)
    got = {r.page_id: r for r in warc.read_back(index).collect()}
    assert len(got) == len(data)
    for page_id, _, html in data:
        raw = (html or "").encode()
        revisit = html == long and page_id != 3
        assert tuple(got[page_id])[1:] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    places = index.collect()
    for bundle in {r.bundle for r in places}:
        reader = warc.BundleReader(bundle)
        for number in range(len(reader.frames)):
            data_, at = reader.frame(number), 0
            while at < len(data_):  # frames are independent and hold whole records
                fields, _, after = warc.parse(data_, at)
                assert any(r.bundle == bundle and r.frame == number and r.frame_offset == at and r.record_id == fields["warc-record-id"] for r in places)
                at = after
    empty = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_back(empty).collect() == []


# Decontamination

def test_edit_distance():
    rnd = random.Random(2)
    for _ in range(300):
        item, window = ([rnd.randrange(1, 5) for _ in range(rnd.randrange(1, n))] for n in (8, 14))
        best = None
        for a in range(len(window) + 1):
            row = list(range(len(window[a:]) + 1))
            for i, w in enumerate(item, 1):
                row = [i] + row
                row = [row[0]] + [0] * 0 + row[1:]
                new = [i]
                for j, v in enumerate(window[a:], 1):
                    new.append(min(row[j] + (w != v), row[j + 1] + 1, new[-1] + 1))
                row = new
            best = min(row) if best is None else min(best, min(row))
        found = decontam.edit_distance(np.array(item), np.array(window), 99)
        assert found[0] == best
        assert decontam.edit_distance(np.array(item), np.array(window), best - 1) is None


def test_recall_of_edited_items():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(800)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(14, 60)))) for i in range(150)]
    index = decontam.Index([i for i, _ in items], [t for _, t in items], 0.8, 4, 20, 9)
    found = exact = 0
    for i, text in items:
        for edited in (False, True):
            words = text.split()
            for _ in range(len(words) // 5 if edited else 0):
                at = rnd.randrange(len(words))
                words[at:at + 1] = rnd.choice([[], ["zzz"], [words[at], "yyy"]])
            names, owner, _ = decontam.tokens(["%% ".join(rnd.choices(vocabulary, k=40) + words + rnd.choices(vocabulary, k=40)).upper()])
            hits = [h for h in index.matches(names, owner) if h[1] == i]
            found += bool(hits) and edited
            exact += any(h[4] == 0 for h in hits) and not edited
    assert exact == len(items) and found >= 0.95 * len(items)


def test_find_items(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "tiny pair"), (3, None), (4, ""), (5, "tiny pair")], "item_id long, text string")
    data = [(1, "x One, two THREE four five six seven y", 0), (2, "a tiny  pair", 0), (3, "tiny gap pair", 0), (4, None, 0), (5, "", 0),
            (None, "one two changed four five six seven", 0), (6, "one two\n" * 9000 + "tiny pair", 0), (6, "one two\n" * 9000 + "tiny pair", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, hits int")
    for block in (20_000, 2):
        got = decontam.find_items(docs, items, block_items=block).collect()
        assert sorted((str(r.doc_id), [(h.item_id, h.edits, h.start, h.end) for h in r.hits]) for r in got) == sorted([
            ("1", [(1, 0, 1, 8)]), ("2", [(2, 0, 1, 3), (5, 0, 1, 3)]), ("3", []), ("4", []), ("5", []), ("None", [(1, 1, 0, 7)]),
            ("6", [(2, 0, 18000, 18002), (5, 0, 18000, 18002)]), ("6", [(2, 0, 18000, 18002), (5, 0, 18000, 18002)]),
        ])
    assert decontam.find_items(docs, items.limit(0)).where(F.size("hits") > 0).count() == 0
    assert decontam.find_items(docs.limit(0), items).collect() == []


# Piecewise hashes

def test_likeness():
    rnd = random.Random(5)
    text = "".join(rnd.choices("abcdefgh ", k=6000)).encode()
    own = fingerprint.fingerprint(text)
    assert fingerprint.likeness(own, own) == 1.0
    assert fingerprint.likeness(own, fingerprint.fingerprint(text[:2000] + b"inserted" + text[2000:])) > 0.85
    assert 0.5 < fingerprint.likeness(own, fingerprint.fingerprint(text[:4000] + bytes(rnd.choices(range(97, 123), k=2000)))) < 0.85
    assert fingerprint.likeness(own, fingerprint.fingerprint(bytes(rnd.choices(range(97, 123), k=6000)))) == 0.0
    assert fingerprint.likeness(own, fingerprint.fingerprint(text + text)) > 0 and fingerprint.fingerprint(b"") == "3::"
    for _ in range(100):
        a, b = ("".join(rnd.choices("abc", k=rnd.randrange(0, 20))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        assert fingerprint.common_length(a, b) == row[-1]
    rolled = fingerprint.rolling(text)
    assert np.array_equal(rolled[100:], fingerprint.rolling(text[94:])[6:])  # seven bytes decide


def test_compare_with_edits(spark):
    rnd = random.Random(6)
    data = [(i * 7 % 101, "".join(rnd.choices("abcé ñ\n", k=rnd.randrange(0, 300))), 0) for i in range(101)]
    data += [(500, None, 0), (501, "", 0), (502, "x" * 90_000, 0), (503, data[0][1], 0)]
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(spark.createDataFrame(data, "doc_id long, text string, fingerprint int").repartition(7)).collect()}
    order = sorted(data, reverse=True, key=lambda r: r[0])
    assert len(got) == len(data)
    for (doc, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[doc]
        cut = len(text) // 3
        edited = (text[:len(text) - cut] + following[:cut]).encode()
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited).hexdigest()
        assert r.fingerprint == fingerprint.fingerprint(text.encode()) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert r.near_edited == fingerprint.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following.encode()))
    single = fingerprint.compare_with_edits(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and single.near_next == 1.0
    twins = fingerprint.compare_with_edits(spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "c")], "doc_id long, text string"))
    assert twins.count() == 4
    assert fingerprint.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_id_ranges(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(1000), LOWEST, 7, 7]], "at long")
    ranges = ids.withColumn("r", id_ranges(ids, F.col("at"), 8)(F.col("at"))).orderBy("at").collect()
    assert [r.r for r in ranges] == sorted(r.r for r in ranges) and ranges[-1].r == 7


# The pipeline

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stages(spark, stages):
    names = [name for name, *_ in stages]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {name: (before.collect(), after.collect()) for name, before, after in stages}
    for name in names[:-1]:
        assert dict(zip(names, stages))[name][2].columns == columns
        assert {tuple(r) for r in rows[name][1]} <= {tuple(r) for r in rows[name][0]}  # rows are only chosen, never changed
    toxic = {r.doc_id: r.predicted for r in toxicity.classify(stages[0][1], spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert {r.doc_id for r in rows["toxicity"][1]} == {d for d, p in toxic.items() if not p}

    from test_simhash import components, plain_fingerprint

    want = components({r.doc_id: plain_fingerprint(r.text) for r in rows["near_duplicates"][0]})
    assert sorted(r.doc_id for r in rows["near_duplicates"][1]) == sorted(set(want.values()))

    items = [decontam.tokens([r.text])[0] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in rows["decontamination"][1]}
    for r in rows["decontamination"][0]:
        words = decontam.tokens([r.text])[0]
        holds = [i for i in items if decontam.edit_distance(i, words, len(i) // 5)]
        assert (r.doc_id in kept) == (not holds)
    before, after = rows["mixing"]
    copies = {r.doc_id: 0 for r in before}
    for r in after:
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    before, after = rows["sharding"]
    assert sorted(map(tuple, before)) == sorted(tuple(r[c] for c in columns) for r in after)
    sizes = [0] * 24
    for r in after:
        sizes[r.shard] += r["size"]
    biggest = max(r["size"] for r in after)
    assert max(sizes) - min(sizes) <= 2 * biggest


def test_pipeline_run_and_odd_tables(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[-1][2].count()
    odd = [(1, "same text here now", "en", "s", 1, "extra"), (1, "same text here now", "en", "s", 1, "extra"), (None, None, None, None, None, None),
           (2, "", "de", None, 0, "extra"), (3, "word " * 30_000, "en", "t", 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for n, data in enumerate((odd, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{n}-{name}")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "size"]
            if name == "near_duplicates" and data:
                assert docs.count() == 3  # the two without words are one component
        assert docs.columns[6:] == ["size_", "text_crc32", "shard", "slot"]


def test_surrogates_settle_where_nothing_can_be_redrawn(spark):
    data = [(i, f"write to _@{c}.com now") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    data += [(100, "żżł@firma.pl and 李雷@x.cn and ё@почта.example.com"), (101, "Dr. Παπαδόπουλος came")]
    rows = {r.doc_id: r for r in surrogate.replace_entities(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    given = {f"_@{c}.com" for c in "abcdefghijklmnopqrstuvwxyz"}
    made = [rows[i].entities[0].surrogate for i in range(26)]
    assert len(set(made)) == 26 and not given & set(made) and all(m.startswith("_") for m in made)
    text = rows[100].text
    assert not any(c in text for c in ("żżł", "李", "雷", "firma"))
    assert re.fullmatch(r"Dr\. [Ͱ-Ͽ]+ came", rows[101].text) and "Παπαδόπουλος" not in rows[101].text
