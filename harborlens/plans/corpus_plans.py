"""Corpus preparation, vocabularies and slug scoring on the given texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import text as fn
from harborlens.functions.draws import draw_sql, hash_draw
from harborlens.operators import corpus as ops
from harborlens.operators import batches, community, evaluate, language, nearest, vocab
from harborlens.plans.registry import Tables, query
from harborlens.session import cut_lineage

WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
TOKENS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]'))"
STOP_SQL = ", ".join(f"'{w}'" for w in fn.STOPWORDS)
# Fixed values, as the operator's list, written out so that the check does not depend on it.
LABEL_STOP_SQL = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'in', 'is', 'it', 'no', 'not', 'of', 'on',
    'or', 'that', 'the', 'this', 'to', 'was', 'were', 'with'"""


def docs(t: Tables):
    return t.spread("documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


# Slugs


PAGES_SQL = """pages_named AS (SELECT page_id AS id, html, regexp_replace(url, '[?#].*$', '') || '/' ||
    regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')
    || '.html' AS url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages)"""
SLUG_SQL = f"""stems AS (SELECT *, regexp_replace(lower(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'),
      lambda s: s <> '' AND NOT regexp_matches(lower(s), '^(index|page|post|article|default|category|tag|archive|feed|rss|print|embed)[.](html?|php|aspx?|xml|json)$'))[-1]),
      '[.](html?|php|aspx?|htm|shtml|xml)$', '') AS stem FROM pages_named),
    tokens AS (SELECT *, replace(stem, '_', '-') AS candidate, string_split(replace(stem, '_', '-'), '-') AS ts FROM stems),
    slugged AS (SELECT id, url, text, CASE WHEN regexp_matches(stem, '^[a-z0-9]+([-_][a-z0-9]+)+$') AND len(ts) BETWEEN 3 AND 8
      AND len(list_filter(ts, lambda x: regexp_matches(x, '^[0-9]+$'))) < 2
      AND len(list_filter(ts, lambda x: regexp_matches(x, '^[0-9]+$') AND COALESCE(TRY_CAST(x AS INTEGER), 99) > 31)) = 0
      AND len(list_filter(ts, lambda x: length(x) > 1)) >= 3
      AND CAST(len(list_filter(ts, lambda x: x IN ({STOP_SQL}))) AS DOUBLE) / len(ts) <= 0.4 THEN candidate END AS slug FROM tokens)"""


def pages(t: Tables):
    """Pages whose URL ends in the words of their title."""
    title = F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "[^a-z0-9]+", "-")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"), F.regexp_replace(title, "^-|-$", ""), F.lit(".html"))
    return t.spread("pages").select(F.col("page_id").alias("id"), url.alias("url"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))


@query("extract_slug", f"WITH {PAGES_SQL}, {SLUG_SQL} SELECT id, url, slug FROM slugged")
def extract_slug(t: Tables):
    return pages(t).select("id", "url", fn.extract_slug(F.col("url")).alias("slug"))


@query(
    "label_checks",
    f"""WITH titles AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
    cleaned AS (SELECT id, replace(title, ' ', '-') AS raw, regexp_replace(lower(trim('"' || replace(title, ' ', '-') || '"')), '^["''`]+|["''`]+$', '', 'g') AS label FROM titles)
    SELECT id, regexp_matches(raw, '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(raw) BETWEEN 3 AND 80 AND len(string_split(raw, '-')) BETWEEN 2 AND 8 AS valid,
    CASE WHEN regexp_matches(label, '^[a-z0-9]+(-[a-z0-9]+)*$') AND len(string_split(label, '-')) <= 8 AND length(label) BETWEEN 3 AND 80
      AND len(list_filter(string_split(label, '-'), lambda x: x IN ({LABEL_STOP_SQL}))) = 0 THEN label END AS label,
    sha256(raw) AS stable FROM cleaned""",
)
def label_checks(t: Tables):
    raw = F.replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" "), F.lit("-"))
    return t.pages.select(
        F.col("page_id").alias("id"), fn.is_valid_slug(raw).alias("valid"),
        fn.clean_label(F.concat(F.lit('"'), raw, F.lit('"'))).alias("label"), fn.stable_id(raw).alias("stable"),
    )


# Text filters


def profile_sql(language: str) -> str:
    hits = {
        lang: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in profile)})))"
        for lang, profile in ops.PROFILES.items()
    }
    total = " + ".join(hits.values())
    return f"CASE WHEN {total} > 0 THEN CAST({hits[language]} AS DOUBLE) / ({total}) ELSE 0 END"


@query(
    "language_filter",
    f"""WITH w AS (SELECT doc_id AS id, lang, {WORDS.format('text')} AS ws FROM documents)
    SELECT id, lang FROM w WHERE {profile_sql('en')} >= 0.65""",
)
def language_filter(t: Tables):
    return ops.language_filter(docs(t), "en").select("id", "lang")


def language_model(t: Tables):
    """Fitted without the documents whose id has a crc32 that is a multiple of five."""
    rows = docs(t)
    return rows, language.fit(rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))


@query("language_model")
def language_model_scores(t: Tables):
    rows, model = language_model(t)
    found = language.language_probabilities(model, F.col("text"), t.spark)
    return rows.withColumn("found", found).select("id", "lang", "found.language", F.round("found.probability", 6).alias("probability"))


@query("language_model_filter")
def language_model_filter(t: Tables):
    rows, model = language_model(t)
    return language.model_filter(rows, model, "en", 0.65).select("id", "lang")


def duplicates_sql(separator: str) -> str:
    pieces = f"list_filter(string_split_regex(trim(text), '{separator}'), lambda p: p <> '')"
    letters = "list_sum(list_transform({0}, lambda p: length(p)))"
    return f"""SELECT id, CASE WHEN len(ps) > 0 THEN CAST(len(ps) - len(list_distinct(ps)) AS DOUBLE) / len(ps) ELSE 0 END AS by_count,
    CASE WHEN length(text) > 0 THEN CAST(COALESCE({letters.format('ps')}, 0) - COALESCE({letters.format('list_distinct(ps)')}, 0) AS DOUBLE)
    / length(text) ELSE 0 END AS by_chars FROM (SELECT doc_id AS id, text, {pieces} AS ps FROM documents)"""


def grams_sql(n: int) -> str:
    """Positions of all n-grams of a text, with a hash of their words."""
    return f"""SELECT id, total, i, hash(ws[i + 1 : i + {n}]) AS g, ls FROM (SELECT id, total, ws, ls, unnest(range(0, len(ws) - {n} + 1)) AS i FROM w)"""


def top_sql(n: int) -> str:
    letters = " + ".join(f"ls[i + {k}]" for k in range(1, n + 1))
    return f"""SELECT id, arg_max(CASE WHEN c > 1 THEN CAST(c * letters AS DOUBLE) / total ELSE 0 END, c * 1000000 + letters) AS top_{n}
    FROM (SELECT id, g, any_value(total) AS total, COUNT(*) AS c, any_value({letters}) AS letters FROM ({grams_sql(n)}) GROUP BY id, g) GROUP BY id"""


def dup_sql(n: int) -> str:
    return f"""SELECT id, CAST(SUM(letters) AS DOUBLE) / any_value(total) AS dup_{n} FROM (SELECT DISTINCT id, total, i + k AS p, ls[i + k + 1] AS letters
    FROM (SELECT g.* FROM ({grams_sql(n)}) g JOIN (SELECT id, g, MIN(i) AS first FROM ({grams_sql(n)}) GROUP BY 1, 2 HAVING COUNT(*) > 1) f
    ON f.id = g.id AND f.g = g.g AND g.i > f.first), range(0, {n}) r(k)) GROUP BY id"""


REPETITION_SQL = (
    f"WITH w AS (SELECT *, list_transform(ws, lambda v: length(v)) AS ls FROM (SELECT doc_id AS id, greatest(length(text), 1) AS total, {WORDS.format('text')} AS ws FROM documents)), "
    + f"lines_ AS ({duplicates_sql('\\n+')}), paragraphs_ AS ({duplicates_sql('\\n{2,}')}), "
    + ", ".join(f"t{n} AS ({top_sql(n)})" for n in ops.TOP_NGRAM_CHARS) + ", "
    + ", ".join(f"d{n} AS ({dup_sql(n)})" for n in ops.DUPLICATE_NGRAM_CHARS)
    + ", measured AS (SELECT w.id, lines_.by_count AS line_count, lines_.by_chars AS line_chars, paragraphs_.by_count AS paragraph_count, "
    + "paragraphs_.by_chars AS paragraph_chars, "
    + ", ".join([f"COALESCE(top_{n}, 0) AS top_{n}" for n in ops.TOP_NGRAM_CHARS] + [f"COALESCE(dup_{n}, 0) AS dup_{n}" for n in ops.DUPLICATE_NGRAM_CHARS])
    + " FROM w JOIN lines_ USING (id) JOIN paragraphs_ USING (id) "
    + " ".join([f"LEFT JOIN t{n} USING (id)" for n in ops.TOP_NGRAM_CHARS] + [f"LEFT JOIN d{n} USING (id)" for n in ops.DUPLICATE_NGRAM_CHARS]) + ") "
)
FIT_SQL = " AND ".join(
    ["line_count <= 0.3", "line_chars <= 0.2", "paragraph_count <= 0.3", "paragraph_chars <= 0.2"]
    + [f"top_{n} <= {v}" for n, v in ops.TOP_NGRAM_CHARS.items()] + [f"dup_{n} <= {v}" for n, v in ops.DUPLICATE_NGRAM_CHARS.items()]
)


@query("repetition_measures", REPETITION_SQL + "SELECT * FROM measured")
def repetition_measures(t: Tables):
    m = ops.repetition_measures(docs(t)).select("id", F.col("repetition").alias("m"))
    return m.select(
        "id", F.col("m.lines.by_count").alias("line_count"), F.col("m.lines.by_chars").alias("line_chars"),
        F.col("m.paragraphs.by_count").alias("paragraph_count"), F.col("m.paragraphs.by_chars").alias("paragraph_chars"),
        *[F.col(f"m.top_{n}").alias(f"top_{n}") for n in ops.TOP_NGRAM_CHARS],
        *[F.col(f"m.dup_{n}").alias(f"dup_{n}") for n in ops.DUPLICATE_NGRAM_CHARS],
    )


@query("repetition_filter", REPETITION_SQL + f"SELECT id FROM measured WHERE {FIT_SQL}")
def repetition_filter(t: Tables):
    return ops.repetition_filter(docs(t)).select("id")


@query(
    "web_quality_filter",
    f"""WITH l AS (SELECT doc_id AS id, text, list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '') AS ls, {WORDS.format('text')} AS ws FROM documents),
    m AS (SELECT id, CAST(len(list_filter(ls, lambda x: regexp_matches(trim(x), '[.!?"''…]$'))) AS DOUBLE) / greatest(len(ls), 1) AS ended,
      CAST(len(list_filter(ls, lambda x: length(x) < 30)) AS DOUBLE) / greatest(len(ls), 1) AS short,
      greatest(COALESCE(list_sum(list_transform(ls, lambda x: length(x))), 0), 1) AS letters,
      greatest(COALESCE(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0), 1) AS once,
      CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) / greatest(len(ws), 1) AS newlines FROM l)
    SELECT id FROM m WHERE ended >= 0.12 AND short <= 0.67 AND CAST(letters - once AS DOUBLE) / letters <= 0.1 AND newlines <= 0.3""",
)
def web_quality_filter(t: Tables):
    return ops.web_quality_filter(docs(t)).select("id")


@query(
    "token_count_filter",
    f"SELECT * FROM (SELECT doc_id AS id, CAST({TOKENS.format('text')} AS INTEGER) AS token_count FROM documents) WHERE token_count BETWEEN 50 AND 1000",
)
def token_count_filter(t: Tables):
    return ops.token_count_filter(docs(t)).select("id", "token_count")


@query(
    "build_url_corpus",
    f"""WITH {PAGES_SQL}, {SLUG_SQL}, documents AS (SELECT id AS doc_id, text, url, slug FROM slugged WHERE slug IS NOT NULL), spoken AS (SELECT id FROM
    (SELECT doc_id AS id, {WORDS.format('text')} AS ws FROM documents) WHERE {profile_sql('en')} >= 0.65), {REPETITION_SQL[5:].rstrip()},
    fit AS (SELECT id FROM measured WHERE {FIT_SQL}), counted AS (SELECT doc_id AS id, url, text, slug, CAST({TOKENS.format('text')} AS INTEGER) AS token_count FROM documents
      WHERE doc_id IN (SELECT id FROM spoken) AND doc_id IN (SELECT id FROM fit)),
    sized AS (SELECT *, COUNT(*) OVER (PARTITION BY slug) AS uses FROM counted WHERE token_count BETWEEN 50 AND 1000)
    SELECT id, url, text, slug, token_count, 'web' AS source FROM sized WHERE uses < 10""",
)
def build_url_corpus(t: Tables):
    return ops.build_url_corpus(pages(t))


# The corpus for splits and scoring: references weigh words by letters, predictions by count


def keywords_sql(name: str, words: int, weight: str) -> str:
    return f"""{name} AS (SELECT id, string_agg(w, '-' ORDER BY at_) AS slug FROM (SELECT id, w, ROW_NUMBER() OVER (PARTITION BY id
    ORDER BY weight DESC, w) AS at_ FROM (SELECT id, w, {weight} AS weight FROM (SELECT doc_id AS id, unnest({WORDS.format('text')}) AS w FROM documents)
    WHERE regexp_matches(w, '^[a-z0-9]{{3,}}$') GROUP BY id, w)) WHERE at_ <= {words} GROUP BY id)"""


REFERENCE_SQL = keywords_sql("refs", 4, "COUNT(*) * length(w)")
PREDICTION_SQL = keywords_sql("preds", 3, "COUNT(*)")
CORPUS_SQL = f"""{REFERENCE_SQL}, corpus AS (SELECT doc_id AS id, source, CAST({TOKENS.format('text')} AS INTEGER) AS token_count, slug
    FROM documents JOIN refs ON id = doc_id)"""


def corpus(t: Tables):
    named = docs(t).join(ops.keyword_slugs(docs(t), 4, by_letters=True), "id")
    return named.select("id", "source", fn.token_count(F.col("text")).alias("token_count"), "slug")


def predictions(t: Tables):
    return ops.keyword_slugs(docs(t), 3).withColumnRenamed("slug", "prediction")


SHORT_SQL = keywords_sql("short", 1, "COUNT(*)")


@query(
    "slug_frequency_filter",
    f"WITH {SHORT_SQL} SELECT id, slug FROM (SELECT *, COUNT(*) OVER (PARTITION BY slug) AS n FROM short) WHERE n < 10",
)
def slug_frequency_filter(t: Tables):
    return ops.slug_frequency_filter(ops.keyword_slugs(docs(t), 1))


@query(
    "corpus_stats",
    f"""WITH {CORPUS_SQL} SELECT COUNT(*) AS rows, CAST(SUM(token_count) AS DOUBLE) / COUNT(*) AS mean_tokens, COUNT(DISTINCT slug) AS slugs,
    (SELECT COUNT(DISTINCT w) FROM (SELECT unnest(string_split(slug, '-')) AS w FROM corpus)) AS vocabulary FROM corpus""",
)
def corpus_stats(t: Tables):
    return ops.corpus_stats(corpus(t))


@query(
    "slug_lengths",
    f"""WITH {CORPUS_SQL} SELECT CAST(len(string_split(slug, '-')) AS INTEGER) AS words, COUNT(*) AS n,
    CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM corpus) * 100 AS pct FROM corpus GROUP BY 1""",
)
def slug_lengths(t: Tables):
    return ops.slug_lengths(corpus(t))


@query(
    "stopword_density",
    f"""WITH {PREDICTION_SQL}, s AS (SELECT CAST(len(list_filter(string_split(slug, '-'), lambda x: x IN ({STOP_SQL}))) AS DOUBLE)
    / len(string_split(slug, '-')) AS s FROM preds) SELECT ROUND(SUM(s) / COUNT(s), 9) AS mean, ROUND(quantile_cont(s, 0.5), 9) AS median,
    ROUND(quantile_cont(s, 0.9), 9) AS p90, ROUND(MAX(s), 9) AS max FROM s""",
)
def stopword_density(t: Tables):
    d = ops.stopword_density(predictions(t).withColumnRenamed("prediction", "slug"))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


@query(
    "source_by_length",
    f"""WITH b AS (SELECT source, CASE WHEN n >= 50 AND n < 200 THEN 'short' WHEN n >= 200 AND n < 500 THEN 'medium' WHEN n >= 500 AND n < 1000
    THEN 'long' ELSE 'other' END AS b FROM (SELECT source, {TOKENS.format('text')} AS n FROM documents))
    SELECT source, COUNT(*) FILTER (b = 'short') AS short, COUNT(*) FILTER (b = 'medium') AS medium, COUNT(*) FILTER (b = 'long') AS long,
    COUNT(*) FILTER (b = 'other') AS other FROM b GROUP BY 1""",
)
def source_by_length(t: Tables):
    sized = docs(t).withColumn("token_count", fn.token_count(F.col("text")))
    return ops.source_by_length(sized, ["short", "medium", "long", "other"])


QUOTAS = {"src0": 10, "src1": 25, "src7": 1000}


@query(
    "take_per_source",
    """SELECT id, source FROM (SELECT doc_id AS id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    WHERE (source = 'src0' AND n <= 10) OR (source = 'src1' AND n <= 25) OR (source = 'src7' AND n <= 1000)""",
)
def take_per_source(t: Tables):
    return ops.take_per_source(docs(t), QUOTAS).select("id", "source")


@query(
    "union_of_sources",
    """(SELECT doc_id AS id, text, 'docs' AS source FROM documents ORDER BY doc_id LIMIT 100) UNION ALL
    (SELECT page_id, html, 'pages' FROM pages ORDER BY page_id LIMIT 50) UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark""",
)
def union_of_sources(t: Tables):
    """Quota'd sources one after another (the quota is the feature)."""
    a = t.documents.selectExpr("doc_id AS id", "text", "'docs' AS source")
    b = t.pages.selectExpr("page_id AS id", "html AS text", "'pages' AS source")
    c = t.benchmark.selectExpr("item_id AS id", "text", "'benchmark' AS source")
    return ops.take_per_source(a.unionByName(b).unionByName(c), {"docs": 100, "pages": 50, "benchmark": 1_000_000_000})


SPLIT_SQL = """sizes AS (SELECT label AS cluster, COUNT(*) AS n FROM embeddings GROUP BY 1), ordered AS (SELECT cluster,
    COALESCE(SUM(n) OVER (ORDER BY (cluster * 7) % 10, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    (SELECT COUNT(*) FROM embeddings) AS total FROM sizes), splits AS (SELECT vec_id AS id, label AS cluster, CASE WHEN before < FLOOR(total * 0.8) THEN 'train'
    WHEN before < FLOOR(total * 0.9) THEN 'val' ELSE 'test' END AS split FROM embeddings JOIN ordered ON cluster = label)"""


def splits(t: Tables):
    clustered = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return ops.assign_splits(clustered, F.pmod(F.col("cluster") * 7, F.lit(10)))


@query("assign_splits", f"WITH {SPLIT_SQL} SELECT id, cluster, split FROM splits")
def assign_splits(t: Tables):
    return splits(t)


@query("cluster_split")
def cluster_split(t: Tables):
    return ops.cluster_split(t.embeddings, "vec_id", "embedding")


@query(
    "split_report",
    f"""WITH {SPLIT_SQL}, {CORPUS_SQL} SELECT split, COUNT(*) AS rows, COUNT(c.id) AS with_slug FROM splits s LEFT JOIN corpus c ON c.id = s.id GROUP BY 1""",
)
def split_report(t: Tables):
    return ops.split_report(splits(t), corpus(t))


@query(
    "three_way_split",
    f"WITH {SPLIT_SQL}, {CORPUS_SQL} SELECT id, source, token_count, slug, vec_id, label FROM corpus JOIN splits USING (id) JOIN embeddings ON vec_id = id WHERE split = 'train'",
)
def three_way_split(t: Tables):
    vectors = t.embeddings.withColumn("id", F.col("vec_id"))
    return ops.three_way_split(corpus(t), splits(t), vectors, "train").drop("embedding")


@query("resume_missing", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_missing(t: Tables):
    return ops.resume_missing(docs(t), t.labels.select(F.col("doc_id").alias("id"))).select("id", "lang")


@query(
    "outside_split",
    f"WITH {SPLIT_SQL} SELECT COUNT(*) AS outside FROM labels WHERE doc_id NOT IN (SELECT id FROM splits WHERE split = 'train')",
)
def outside_split(t: Tables):
    return ops.outside_split(t.labels.select(F.col("doc_id").alias("id")), splits(t), "train")


@query(
    "union_test_ids",
    f"WITH {SPLIT_SQL} SELECT id FROM splits WHERE split = 'test' UNION SELECT doc_id FROM labels WHERE quality = 0",
)
def union_test_ids(t: Tables):
    other = t.labels.selectExpr("doc_id AS id", "CASE WHEN quality = 0 THEN 'test' ELSE 'train' END AS split")
    return ops.union_test_ids([splits(t), other])


@query(
    "distilled_labels",
    f"""WITH {PREDICTION_SQL}, {REFERENCE_SQL}, written AS (SELECT id, 1 AS attempt, slug || CASE WHEN id % 2 = 0 THEN '!' ELSE '' END AS label FROM preds
      UNION ALL SELECT id, 2, upper(slug) FROM refs), cleaned AS (SELECT id, attempt, lower(label) AS slug FROM written
      WHERE regexp_matches(lower(label), '^[a-z0-9]+(-[a-z0-9]+)*$') AND len(string_split(label, '-')) <= 8 AND length(label) BETWEEN 3 AND 80
      AND len(list_filter(string_split(lower(label), '-'), lambda x: x IN ({LABEL_STOP_SQL}))) = 0)
    SELECT id, lang, arg_min(slug, attempt) AS slug FROM cleaned JOIN documents ON doc_id = id GROUP BY 1, 2""",
)
def distilled_labels(t: Tables):
    first = ops.keyword_slugs(docs(t), 3).selectExpr("id", "1 AS attempt", "CONCAT(slug, CASE WHEN id % 2 = 0 THEN '!' ELSE '' END) AS label")
    second = ops.keyword_slugs(docs(t), 4, by_letters=True).selectExpr("id", "2 AS attempt", "UPPER(slug) AS label")
    return ops.distilled_labels(docs(t).select("id", "lang"), first.unionByName(second))


@query(
    "pack_batches",
    f"""WITH s AS (SELECT doc_id AS id, CAST({TOKENS.format('text')} AS INTEGER) AS token_count FROM documents)
    SELECT *, CAST(FLOOR((SUM(token_count) OVER (ORDER BY id) - token_count) / 8000.0) AS BIGINT) AS batch FROM s""",
)
def pack_batches(t: Tables):
    sized = docs(t).select("id", fn.token_count(F.col("text")).alias("token_count"))
    return ops.pack_batches(sized, 8000)


@query(
    "fill_batches",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id AS id, CAST({TOKENS.format('text')} AS INTEGER) AS token_count, ROW_NUMBER() OVER (ORDER BY doc_id) AS n FROM documents),
    walk AS (SELECT n, token_count AS held, CAST(0 AS BIGINT) AS batch FROM s WHERE n = 1
      UNION ALL SELECT s.n, CASE WHEN held + token_count > 8000 THEN token_count ELSE held + token_count END, CASE WHEN held + token_count > 8000 THEN batch + 1 ELSE batch END
      FROM walk JOIN s ON s.n = walk.n + 1)
    SELECT id, token_count, batch FROM s JOIN walk USING (n)""",
)
def fill_batches(t: Tables):
    sized = docs(t).select("id", fn.token_count(F.col("text")).alias("token_count"))
    return batches.fill_batches(sized, 8000)


# Vocabulary


VOCAB_SQL = f"""{REFERENCE_SQL}, counts AS (SELECT token, COUNT(*) AS frequency FROM (SELECT unnest(string_split(slug, '-')) AS token FROM refs) GROUP BY 1),
    vocab AS (SELECT token, ROW_NUMBER() OVER (ORDER BY token) - 1 AS index FROM counts),
    tokens AS (SELECT token, frequency, index AS number, embedding AS vector, label FROM counts JOIN vocab USING (token)
      JOIN embeddings ON vec_id = index % (SELECT COUNT(*) FROM embeddings))"""


def references(t: Tables):
    return ops.keyword_slugs(docs(t), 4, by_letters=True)


@query("token_counts", f"WITH {VOCAB_SQL} SELECT * FROM counts")
def token_counts(t: Tables):
    return vocab.token_counts(references(t))


@query("build_vocab", f"WITH {VOCAB_SQL} SELECT * FROM vocab")
def build_vocab(t: Tables):
    return vocab.build_vocab(references(t))


def tokens(t: Tables):
    """All vocabulary words with a vector each: the words take the embeddings in turn."""
    slugs = references(t)
    numbered = vocab.build_vocab(slugs).join(vocab.token_counts(slugs), "token")
    vectors = t.embeddings.count()
    return numbered.withColumn("_turn", F.col("index") % F.lit(vectors)).join(t.embeddings, F.col("_turn") == F.col("vec_id")).select(
        "token", "frequency", F.col("index").alias("number"), F.col("embedding").alias("vector"), "label"
    )


MAPPING_SQL = f"""{VOCAB_SQL}, mapping AS (SELECT token, label AS cluster, FIRST_VALUE(token) OVER (PARTITION BY label ORDER BY frequency DESC, far, token) AS representative
    FROM (SELECT t.*, ROUND(sqrt(list_sum(list_transform(list_zip(vector, center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 10) AS far FROM tokens t
    JOIN (SELECT label, list(x ORDER BY d) AS center FROM (SELECT label, d, AVG(CAST(vector[d] AS DOUBLE)) AS x FROM tokens, range(1, 65) r(d) GROUP BY 1, 2) GROUP BY 1)
    USING (label)))"""


@query("representatives", f"WITH {MAPPING_SQL} SELECT * FROM mapping")
def representatives(t: Tables):
    return vocab.representatives(tokens(t).withColumnRenamed("label", "cluster"))


@query(
    "encode_slugs",
    f"""WITH {MAPPING_SQL}, words AS (SELECT id, unnest(string_split(slug, '-')) AS token, generate_subscripts(string_split(slug, '-'), 1) AS at_ FROM refs),
    coded AS (SELECT id, list(index ORDER BY at_) AS indices FROM words LEFT JOIN mapping USING (token) JOIN vocab v ON v.token = COALESCE(representative, words.token) GROUP BY 1)
    SELECT refs.id, COALESCE(indices, []) AS indices FROM refs LEFT JOIN coded USING (id)""",
)
def encode_slugs(t: Tables):
    mapping = vocab.representatives(tokens(t).withColumnRenamed("label", "cluster"))
    return vocab.encode_slugs(references(t), vocab.build_vocab(references(t)), mapping)


@query("compress_kmeans")
def compress_kmeans(t: Tables):
    return vocab.compress_kmeans(tokens(t), 50)


GRAPH_MAPPING_SQL = f"""{VOCAB_SQL}, near AS (SELECT a.number AS src, b.number AS dst FROM tokens a, tokens b WHERE ROUND(list_cosine_similarity(
    list_transform(a.vector, lambda v: CAST(v AS DOUBLE)), list_transform(b.vector, lambda v: CAST(v AS DOUBLE))), 9) >= 0.4 AND a.number <> b.number
    UNION SELECT number, number FROM tokens),
    reach AS (SELECT src AS node, src AS label FROM near UNION SELECT n.dst, r.label FROM reach r JOIN near n ON n.src = r.node WHERE r.label < n.dst),
    comp AS (SELECT node AS number, MIN(label) AS cluster FROM reach GROUP BY 1),
    grouped AS (SELECT token, cluster, FIRST_VALUE(token) OVER (PARTITION BY cluster ORDER BY frequency DESC, far, token) AS representative
      FROM (SELECT t.*, comp.cluster, ROUND(sqrt(list_sum(list_transform(list_zip(vector, center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 10) AS far
      FROM tokens t JOIN comp USING (number) JOIN (SELECT cluster, list(x ORDER BY d) AS center FROM (SELECT cluster, d, AVG(CAST(vector[d] AS DOUBLE)) AS x
        FROM tokens JOIN comp USING (number), range(1, 65) r(d) GROUP BY 1, 2) GROUP BY 1) c ON c.cluster = comp.cluster))"""


@query("compress_graph", f"WITH RECURSIVE {GRAPH_MAPPING_SQL} SELECT * FROM grouped")
def compress_graph(t: Tables):
    return vocab.compress_graph(tokens(t), 0.4)


@query(
    "label_modularity",
    f"""WITH {VOCAB_SQL}, near AS (SELECT a.number AS src, b.number AS dst, a.label = b.label AS same FROM tokens a, tokens b WHERE a.number <> b.number AND
    ROUND(list_cosine_similarity(list_transform(a.vector, lambda v: CAST(v AS DOUBLE)), list_transform(b.vector, lambda v: CAST(v AS DOUBLE))), 9) >= 0.4),
    per AS (SELECT label, CAST(COUNT(*) AS DOUBLE) AS tot FROM near JOIN tokens ON number = src GROUP BY 1)
    SELECT (SELECT COUNT(*) FROM per) AS communities, CAST(COUNT(*) AS DOUBLE) AS total,
    ROUND(CAST(COUNT(*) FILTER (same) AS DOUBLE) / COUNT(*) - (SELECT SUM(tot * tot) FROM per) / (CAST(COUNT(*) AS DOUBLE) * COUNT(*)), 9) AS modularity FROM near""",
)
def label_modularity(t: Tables):
    """How well the given labels part the similarity graph of the words."""
    words = cut_lineage(tokens(t))
    edges = nearest.cosine_radius_graph(words, "number", "vector", 0.4)
    edges = edges.select(F.col("id").alias("src"), F.col("neighbor").alias("dst"), F.lit(1).alias("weight"))
    found = community.modularity(edges, words.select(F.col("number").alias("node"), F.col("label").alias("community")))
    return found.withColumn("modularity", F.round("modularity", 9))


@query("compress_communities")
def compress_communities(t: Tables):
    return vocab.compress_communities(tokens(t), 0.4)


@query(
    "compression_report",
    f"""WITH {MAPPING_SQL} SELECT 'label' AS strategy, (SELECT COUNT(DISTINCT cluster) FROM mapping) AS clusters,
    (SELECT COUNT(*) FROM (SELECT cluster FROM mapping GROUP BY 1 HAVING COUNT(*) = 1)) AS noise,
    COUNT(*) AS representatives, CAST(SUM(frequency) AS DOUBLE) / (SELECT SUM(frequency) FROM counts) AS coverage
    FROM counts WHERE token IN (SELECT representative FROM mapping)""",
)
def compression_report(t: Tables):
    by_label = vocab.Grouping("label", lambda df: vocab.representatives(df.withColumnRenamed("label", "cluster")))
    return vocab.compression_report(by_label.name, by_label.fit(tokens(t)), vocab.token_counts(references(t)))


# Scoring


SAMPLES_SQL = f"""{CORPUS_SQL}, {PREDICTION_SQL}, samples AS (SELECT c.id, p.slug AS prediction, c.slug AS reference, source, token_count,
    string_split(p.slug, '-') AS pw, string_split(c.slug, '-') AS rw FROM corpus c JOIN preds p USING (id)),
    shared AS (SELECT *, len(list_intersect(list_distinct(pw), list_distinct(rw))) AS common FROM samples),
    pr AS (SELECT *, CAST(common AS DOUBLE) / len(list_distinct(pw)) AS precision, CAST(common AS DOUBLE) / len(list_distinct(rw)) AS recall FROM shared),
    scored AS (SELECT *, prediction = reference AS exact, regexp_matches(prediction, '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(prediction) BETWEEN 3 AND 80
      AND len(pw) BETWEEN 2 AND 8 AS valid, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0 END AS f1,
      CASE WHEN common > 0 THEN CAST(2.0 AS DOUBLE) * common / (len(pw) + len(rw)) ELSE 0 END AS rouge1,
      CAST(len(pw) AS INTEGER) AS prediction_words, CAST(len(rw) AS INTEGER) AS reference_words,
      CASE WHEN token_count >= 50 AND token_count < 200 THEN 'short' WHEN token_count >= 200 AND token_count < 500 THEN 'medium'
        WHEN token_count >= 500 AND token_count < 1000 THEN 'long' ELSE 'other' END AS length_bucket FROM pr)"""


def samples(t: Tables):
    wanted = corpus(t).withColumnRenamed("slug", "reference")
    return predictions(t).join(wanted, "id").select("id", "prediction", "reference", "source", "token_count")


# The longest common subsequence of at most 3 and 4 words, over all increasing position choices.
LCS_SQL = """COALESCE((SELECT MAX(n) FROM (SELECT len(list_filter([a, b, c], lambda v: v > 0)) AS n
    FROM range(0, len(rw) + 1) x(a), range(0, len(rw) + 1) y(b), range(0, len(rw) + 1) z(c)
    WHERE (a = 0 OR (len(pw) >= 1 AND pw[1] = rw[a])) AND (b = 0 OR (len(pw) >= 2 AND pw[2] = rw[b])) AND (c = 0 OR (len(pw) >= 3 AND pw[3] = rw[c]))
    AND (a = 0 OR b = 0 OR a < b) AND (b = 0 OR c = 0 OR b < c) AND (a = 0 OR c = 0 OR a < c))), 0)"""
DETAIL_SQL = f"""{SAMPLES_SQL}, longest AS (SELECT *, {LCS_SQL} AS lcs FROM scored),
    detail AS (SELECT id, prediction, reference, source, token_count, exact, valid, precision, recall, f1, rouge1,
      CASE WHEN lcs > 0 THEN CAST(2.0 AS DOUBLE) * lcs / (len(pw) + len(rw)) ELSE 0 END AS rouge_l, prediction_words, reference_words, length_bucket FROM longest)"""


@query("score", f"WITH {DETAIL_SQL} SELECT * FROM detail")
def score(t: Tables):
    return evaluate.score(samples(t))


def mean_sql(name: str, cast: str = "") -> str:
    value = f"CAST({name} AS INTEGER)" if cast else name
    return f"CAST(SUM(CAST({value} AS DECIMAL(18, 12))) AS DOUBLE) / COUNT({name}) AS mean_{name}"


@query(
    "evaluate",
    f"""WITH {DETAIL_SQL} SELECT COUNT(*) AS n, {', '.join(mean_sql(m, 'int' if m in ('exact', 'valid') else '') for m in evaluate.MEANS)},
    quantile_cont(prediction_words, 0.5) AS median_prediction_words, quantile_cont(reference_words, 0.5) AS median_reference_words,
    CAST(COUNT(DISTINCT prediction) AS DOUBLE) / COUNT(*) AS vocab_diversity FROM detail""",
)
def evaluate_all(t: Tables):
    return evaluate.evaluate(evaluate.score(samples(t)))


def breakdown_sql(dim: str) -> str:
    means = ", ".join(mean_sql(m, "int" if m in ("exact", "valid") else "") for m in ("exact", "valid", "f1", "rouge_l"))
    return f"WITH {DETAIL_SQL} SELECT {dim}, COUNT(*) AS n, {means} FROM detail GROUP BY 1"


@query("breakdown_by_source", breakdown_sql("source"))
def breakdown_by_source(t: Tables):
    return evaluate.breakdown(evaluate.score(samples(t)), "source")


@query("breakdown_by_length", breakdown_sql("length_bucket"))
def breakdown_by_length(t: Tables):
    return evaluate.breakdown(evaluate.score(samples(t)), "length_bucket")


@query(
    "compressed_f1",
    f"""WITH {MAPPING_SQL}, {PREDICTION_SQL}, words AS (SELECT id, unnest(string_split(slug, '-')) AS token FROM refs),
    mapped AS (SELECT id, list_distinct(list(COALESCE(representative, token))) AS ms FROM words LEFT JOIN mapping USING (token) GROUP BY 1),
    pr AS (SELECT p.id, CAST(len(list_intersect(string_split(slug, '-'), ms)) AS DOUBLE) / len(string_split(slug, '-')) AS p,
      CAST(len(list_intersect(string_split(slug, '-'), ms)) AS DOUBLE) / len(ms) AS r FROM preds p JOIN mapped m ON p.id = m.id)
    SELECT id, p AS compressed_precision, r AS compressed_recall, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0 END AS compressed_f1 FROM pr""",
)
def compressed_f1(t: Tables):
    mapping = vocab.representatives(tokens(t).withColumnRenamed("label", "cluster"))
    return evaluate.compressed_f1(samples(t), mapping)


@query(
    "evaluation_set",
    f"WITH {SAMPLES_SQL} SELECT id, prediction, reference, source, token_count, label FROM samples JOIN embeddings ON vec_id = id",
)
def evaluation_set(t: Tables):
    vectors = t.embeddings.withColumnRenamed("vec_id", "id")
    return evaluate.evaluation_set(predictions(t), corpus(t), vectors).drop("embedding")


@query(
    "distinctiveness",
    f"""WITH {PREDICTION_SQL}, s AS (SELECT p.id, list_distinct(string_split(slug, '-')) AS ws, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v
      FROM preds p JOIN embeddings ON vec_id = p.id), pairs AS (SELECT a.id, a.ws, b.ws AS other, ROUND(list_cosine_similarity(a.v, b.v), 9) AS sim, b.id AS nb
      FROM s a, s b WHERE a.id <> b.id), best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY sim DESC, nb) AS n FROM pairs)
    SELECT id, ROUND(CASE WHEN SUM(sim) > 0 THEN SUM(sim * (1.0 - CAST(len(list_intersect(ws, other)) AS DOUBLE) / len(list_distinct(list_concat(ws, other))))) / SUM(sim)
    ELSE 0 END, 6) AS distinctiveness FROM best WHERE n <= 5 GROUP BY 1""",
)
def distinctiveness(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    scored = evaluate.distinctiveness(predictions(t).join(vectors, "id"), 5, block_rows=512)
    return scored.withColumn("distinctiveness", F.round("distinctiveness", 6))


@query(
    "compare_runs",
    f"""WITH {DETAIL_SQL}, runs AS (SELECT 'keywords' AS run, * FROM detail UNION ALL SELECT 'english', * FROM detail WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
    means AS (SELECT run, CAST(SUM(CAST(f1 AS DECIMAL(18, 12))) AS DOUBLE) / COUNT(f1) AS f1, CAST(SUM(CAST(rouge_l AS DECIMAL(18, 12))) AS DOUBLE) / COUNT(rouge_l) AS rouge_l FROM runs GROUP BY 1),
    long AS (UNPIVOT means ON f1, rouge_l INTO NAME measure VALUE value)
    SELECT measure, MAX(CASE WHEN run = 'keywords' THEN value END) AS keywords, MAX(CASE WHEN run = 'english' THEN value END) AS english FROM long GROUP BY 1""",
)
def compare_runs(t: Tables):
    detail = evaluate.score(samples(t))
    english = detail.join(docs(t).where("lang = 'en'").select("id"), "id", "left_semi")
    return evaluate.compare_runs({"keywords": detail, "english": english}, ["f1", "rouge_l"])


@query(
    "metric_cdf",
    f"""WITH {DETAIL_SQL}, c AS (SELECT source, f1 AS value, COUNT(*) AS n FROM detail GROUP BY 1, 2)
    SELECT source, value, CAST(SUM(n) OVER (PARTITION BY source ORDER BY value) AS DOUBLE) / SUM(n) OVER (PARTITION BY source) AS cdf FROM c""",
)
def metric_cdf(t: Tables):
    return evaluate.metric_cdf(evaluate.score(samples(t)), "source", "f1")


@query(
    "random_baseline",
    f"""WITH {SPLIT_SQL}, {CORPUS_SQL}, train AS (SELECT slug, ROW_NUMBER() OVER (ORDER BY c.id) AS n FROM corpus c JOIN splits s ON s.id = c.id AND split = 'train'),
    test AS (SELECT c.id, {draw_sql('c.id', seed=9)} AS draw FROM corpus c JOIN splits s ON s.id = c.id AND split <> 'train')
    SELECT id, slug AS prediction FROM test JOIN train ON n = CAST(FLOOR(draw * (SELECT COUNT(*) FROM train)) AS BIGINT) + 1""",
)
def random_baseline(t: Tables):
    parts = corpus(t).join(splits(t), "id")
    return evaluate.random_baseline(parts.where("split = 'train'"), parts.where("split <> 'train'"), hash_draw("id", seed=9))


@query(
    "measure_chain",
    f"WITH {SAMPLES_SQL} SELECT CAST(SUM(CASE WHEN exact THEN 1 ELSE 0 END) AS BIGINT) AS exact_matches, CAST(SUM(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS valid_slugs FROM scored",
)
def measure_chain(t: Tables):
    """A custom chain: two transforms and two summaries composed by the caller."""
    exact = lambda df: df.withColumn("exact", F.col("prediction") == F.col("reference"))
    valid = lambda df: df.withColumn("valid", fn.is_valid_slug(F.col("prediction")))
    return evaluate.run_measures(samples(t), [exact, valid], [
        F.count_if("exact").alias("exact_matches"), F.count_if("valid").alias("valid_slugs")
    ])
