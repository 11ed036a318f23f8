"""Personal data replaced by keyed, type-consistent surrogates. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import hidden, id_order
from harborlens.session import cut_lineage

#: Given names by gender and script; a surrogate comes from the same row, so the rows are pools as well.
GIVEN_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carmen Charlotte Clara Elena Emily Emma Hannah Ines Isabel Jane Julia Laura Linda Lucia Maria Marie Mary Patricia Sarah Sofia Susan".split(),
    ("m", "latin"): "Andreas Antonio Carlos Charles David Felix Hans James Jean John Jorge Karl Louis Luis Mark Michael Paul Peter Pierre Richard Robert Thomas Walter William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Андрей Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Сергей Юрий".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Doctor Professor Herr Frau Monsieur Madame Señor Señora Господин Госпожа".split()
SYLLABLES = {
    "latin": "ba bel cor dan del fen gar hal hol jen kar kel lan lor mal mer nor pal per quin ral ren sal ser tal tor van vel wen wil yar zan".split(),
    "cyrillic": "ба бел вар вин гор дан дол жар зан зор кал кор лав лен мар мир нар нов ор пал пен рад рол сав сол тар тул фан хор чер шал яр".split(),
    "greek": "βαλ γαρ δαν δορ ζαν θελ θορ καλ κορ λαν λεν μαρ μελ μιρ νορ παλ περ ραν ρεν σαλ σερ ταρ τελ τορ φαν χαρ".split(),
}
_GIVEN = "|".join(sorted((n for pool in GIVEN_NAMES.values() for n in pool), key=len, reverse=True))
_TITLE = "|".join(TITLES)

#: What is detected, in the order in which kinds are told apart. Fixed formats, as Java patterns. A
#: mention starts where no letter or digit stands before it; possessive runs (++) never look twice.
_LOCAL = r"[\p{L}\p{N}_.%+\-]++"
_LABEL = r"[A-Za-z0-9\-]++"
_SURNAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+(?!\p{L})"
PATTERNS = {
    "email": rf"{_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,}}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"\d{4}(?<sep>[ -]?)\d{4}\k<sep>\d{4}\k<sep>\d{4}(?!\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]\(?\d{1,4}\)?(?:[ .-]\d{2,4}){2,4}(?!\d)",
    "secret": r"(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "name": rf"(?:(?:{_TITLE})\.? (?:(?:{_GIVEN}) )?|(?:{_GIVEN}) ){_SURNAME}",
}
_FIRST = {"ip": r"(?=\d)", "card": r"(?=\d)", "ssn": r"(?=\d)", "phone": r"(?=[+(\d])", "secret": "(?=[0-9a-fA-F])", "name": r"(?=\p{Lu})"}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(_FIRST.get(k, "") + f"(?:{p})" for k, p in PATTERNS.items()) + ")"
NAMES = r"(?<![\p{L}\p{N}])(?:" + PATTERNS["name"] + ")"
#: What a character is drawn from: the first pool whose pattern it has.
POOLS = [
    ("0123456789", "[0-9]"),
    ("abcdefghijklmnopqrstuvwxyz", "[a-z]"),
    ("àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "[à-ÿ]"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "[\u0400-\u04FF]"),
    ("αβγδεζηθικλμνξοπρστυφχψω", "[\u0370-\u03FF]"),
    ("āăąćčďđēęěğģīįķĺļľłńņňőŕřśşšťūůűųźżž", "[\u00DF\u0100-\u024F]"),
    ("安白成大方高国海和江金林明南平青山水天文西小新星雨", r"\p{IsHan}"),
    ("abcdefghijklmnopqrstuvwxyz", r"\p{L}"),
]
#: After so many attempts an e-mail address gets longer, and an IP address leaves its private range.
FORMAT_ATTEMPTS = 4
#: Where a value still has no free surrogate after so many attempts, its format has none left to find.
MOST_ATTEMPTS = 64
#: More values with another surrogate than the first choice than this are looked up by a join.
BROADCAST_VALUES = 100_000


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = mention.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _words(mention: Column) -> Column:
    return F.split(mention, " ")


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: lower case, digits only; of a name, its last word."""
    last = F.lower(F.element_at(_words(mention), -1))
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "name", last).otherwise(F.lower(mention))
    )


def _stream(seed: Column, length: Column) -> Column:
    """Two hexadecimal digits per character, as many as asked for."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda j: F.sha2(F.concat(seed, F.lit("|"), j.cast("string")).cast("binary"), 512)), "")


def _number(stream: Column, at: Column) -> Column:
    return F.conv(F.substring(stream, at * 2 + 1, 2), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, 1)


def _characters(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each character by a keyed one of its sort (digit, letter of its script, else a Latin letter); what is neither stays."""
    stream = _stream(seed, F.length(value))

    def one(i: Column) -> Column:
        c, n = F.substring(value, i + 1, 1), _number(stream, i)
        if hexadecimal:
            return _pick("0123456789abcdef", n)
        pool = None
        for letters, pattern in POOLS:
            pool = F.when(c.rlike(pattern), letters) if pool is None else pool.when(c.rlike(pattern), letters)
        return F.coalesce(F.substring(pool, F.pmod(n, F.length(pool)) + 1, F.lit(1)), c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits before a check digit."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(value: Column, seed: Column) -> Column:
    """The first digit stays (the network), the check digit is right exactly if it was."""
    body = F.concat(F.substring(value, 1, 1), _characters(F.substring(value, 2, 14), seed))
    check = F.pmod(-_luhn_sum(body), F.lit(10))
    given = F.substring(value, 16, 1).cast("int")
    valid = F.pmod(-_luhn_sum(F.substring(value, 1, 15)), F.lit(10)) == given
    wrong = F.pmod(check + 1 + F.pmod(_number(_stream(F.concat(seed, F.lit("|check")), F.lit(1)), F.lit(0)), F.lit(9)), F.lit(10))
    return F.concat(body, F.when(valid, check).otherwise(wrong).cast("string"))


def _ip(value: Column, seed: Column, attempt: Column) -> Column:
    """Octets by octets; an address of a private range keeps the range as long as attempts find a free one there."""
    stream = _stream(seed, F.lit(4))
    octets = [_number(stream, F.lit(i)).cast("string") for i in range(4)]
    given = F.split(value, r"\.")
    keep = F.when(value.rlike(r"^(10|127)\."), 1).when(value.rlike(r"^(192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\."), 2).otherwise(0)
    keep = F.when(attempt < 4 * FORMAT_ATTEMPTS, keep).otherwise(0)
    return F.concat_ws(".", *[F.when(keep > i, F.element_at(given, i + 1)).otherwise(octets[i]) for i in range(4)])


def _email(value: Column, key: str, seed: Column, attempt: Column) -> Column:
    """The domain has a surrogate of its own, so addresses of one domain stay together; its last label stays.

    Some attempts on, the local part gets letters, one more each time, so that one without letters or
    digits, or as short as all its neighbours, has free surrogates too.
    """
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    named = _characters(rest, F.concat(F.lit(f"{key}|domain|"), domain))
    more = F.least(F.greatest(attempt - FORMAT_ATTEMPTS, F.lit(0)), F.lit(20))
    letters = F.substring(F.translate(_stream(F.concat(seed, F.lit("|more")), F.lit(20)), "0123456789", "ghijklmnop"), F.lit(1), more)
    return F.concat(_characters(local, seed), letters, F.lit("@"), named, F.lit("."), top)


def _surname(value: Column, seed: Column, attempt: Column) -> Column:
    """Syllables of the same script; endings that show the gender stay; a further attempt adds a syllable."""
    stream = _stream(seed, F.lit(32))
    many = F.greatest(F.lit(3), F.ceil(F.length(value) / 3).cast("int")) + F.least(attempt, F.lit(20))

    def made(script: str) -> Column:
        pool = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.element_at(pool, F.pmod(_number(stream, i), F.lit(len(SYLLABLES[script]))) + 1)), "")

    ending = F.regexp_extract(value, "(ова|ева|ина|ская|ов|ев|ин|ский)$", 1)
    return F.when(value.rlike("[а-я]"), F.concat(made("cyrillic"), ending)).when(value.rlike("[\u0370-\u03FF]"), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical value: a function of kind, value, attempt and the secret key only."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    phone = F.concat(F.substring(value, 1, 1), _characters(F.substring(value, F.lit(2), F.length(value)), seed))
    return (
        F.when(kind == "email", _email(value, key, seed, attempt)).when(kind == "ip", _ip(value, seed, attempt)).when(kind == "card", _card(value, seed))
        .when(kind == "phone", phone).when(kind == "secret", _characters(value, seed, hexadecimal=True))
        .when(kind == "name", _surname(value, seed, attempt)).otherwise(_characters(value, seed))
    )


def given_names(key: str) -> dict[str, str]:
    """A keyed cycle through each pool: no name stays, no two become one."""
    out = {}
    for (gender, script), pool in GIVEN_NAMES.items():
        cycle = sorted(pool, key=lambda n: hashlib.sha256(f"{key}|{gender}|{script}|{n}".encode()).digest())
        out |= dict(zip(cycle, cycle[1:] + cycle[:1]))
    return out


def dressed(kind: Column, mention: Column, value: Column, key: str) -> Column:
    """The surrogate in the mention's format: its separators, its upper case, its title and given name."""
    def digit(i: Column) -> Column:
        c = F.substring(mention, i + 1, 1)
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substring(value, before, 1)).otherwise(c)

    def cased(i: Column) -> Column:
        c, s = F.substring(mention, i + 1, 1), F.substring(value, i + 1, 1)
        return F.when((c != F.lower(c)) & (F.length(value) == F.length(mention)), F.upper(s)).otherwise(s)

    mapping = F.create_map(*[F.lit(x) for pair in given_names(key).items() for x in pair])
    words = _words(mention)
    front = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.coalesce(F.element_at(mapping, w), w))
    places = lambda s: F.sequence(F.lit(0), F.length(s) - 1)
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.array_join(F.transform(places(mention), digit), ""))
        .when(kind == "name", F.array_join(F.concat(front, F.array(F.initcap(value))), " "))
        .when((kind == "secret") & mention.rlike("[A-F]"), F.upper(value))
        .otherwise(F.array_join(F.transform(places(value), cased), ""))
    )


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the canonical values for which attempt 0 is taken.

    A surrogate is free if no smaller value of its kind holds it and it is no value of the text
    itself. Values that miss try again; the settled ones stay, so every round leaves fewer. Names and
    e-mail addresses grow until they are free; a format of fixed length whose values the table
    nearly uses up raises a ValueError after ``MOST_ATTEMPTS``.
    """
    values = cut_lineage(found.select("kind", "value").distinct())
    state = cut_lineage(values.withColumn("attempt", F.lit(0)).withColumn("made", surrogate(F.col("kind"), F.col("value"), F.lit(0), key)))
    for _ in range(MOST_ATTEMPTS):
        holder = state.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = state.join(holder.select("kind", "made", "holder"), ["kind", "made"]).where("value <> holder.value").select("kind", "value")
        real = state.join(values.select("kind", F.col("value").alias("made")), ["kind", "made"]).select("kind", "value")
        missed = cut_lineage(twice.unionByName(real).distinct().withColumn("missed", F.lit(1)))
        if missed.isEmpty():
            return state.where("attempt > 0").select("kind", "value", "attempt")
        again = state.join(missed, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("missed", F.lit(0)))
        fresh = F.when(F.col("missed") == 1, surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("made"))
        state = cut_lineage(again.select("kind", "value", "attempt", fresh.alias("made")))
    left = ", ".join(r.kind for r in missed.select("kind").distinct().collect())
    raise ValueError(f"no free surrogates after {MOST_ATTEMPTS} attempts, of kinds: {left}")


def pattern_of(text: Column) -> Column:
    """What to look for in a text: all kinds, and the surnames of its own names where they stand alone."""
    names = F.regexp_extract_all(text, F.lit(NAMES), F.lit(0))
    surnames = F.array_distinct(F.transform(names, lambda m: F.element_at(_words(m), -1)))
    # Longer ones first, so that no name is taken for the front of another. They are letters and hyphens only.
    ordered = F.array_sort(surnames, lambda x, y: F.length(y) - F.length(x))
    alone = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(surnames) > 0, alone).otherwise(F.lit(ANY))


def mentions(text: Column, pattern: Column) -> Column:
    """(kind, mention, value) of every entity of a text, in order."""
    def entity(m: Column) -> Column:
        kind = F.coalesce(kind_of(m), F.lit("name"))  # a surname alone
        return F.struct(kind.alias("kind"), m.alias("mention"), canonical(kind, m).alias("value"))

    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), entity)


def replace_entities(docs: DataFrame, key: str = "harborlens", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its text rewritten, and ``entities``: array of (kind, surrogate) in order.

    E-mail and IP addresses, card, social security and phone numbers, hexadecimal secrets and
    names are detected: a title or a listed given name before a surname, and that surname wherever
    it stands alone in the same text. A mention becomes the keyed surrogate of its entity, in its own
    format. The same entity has one surrogate in all documents, different entities have different
    ones, and none is a value that some document holds: taken surrogates are settled over all
    distinct values first, and only the values that need another attempt are looked up.

    A null text stays null and has no entities, an empty one stays empty. Rows with equal ids or
    texts are rewritten alike. An empty table stays empty. A column named entities is replaced.
    """
    found_name, over, at, mark, sought = hidden(docs, "_found", "_over", "_at", "_mark", "_sought")
    rows = docs.withColumn(sought, pattern_of(F.col(text_column)))
    rows = rows.withColumn(found_name, F.coalesce(mentions(F.col(text_column), F.col(sought)), F.array().cast("array<struct<kind: string, mention: string, value: string>>")))
    each = cut_lineage(
        rows.select(id_order(id_column).alias("i_"), F.xxhash64(text_column).alias("m_"), F.explode(found_name).alias("e"))
        .select("i_", "m_", "e.kind", "e.value").distinct()
    )
    changed = attempts(each, key)
    count = changed.count()
    if count:
        looked_up = each.join(F.broadcast(changed) if count <= BROADCAST_VALUES else changed, ["kind", "value"])
        per_row = cut_lineage(looked_up.groupBy("i_", "m_").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias(over)))
        few = per_row.count() <= BROADCAST_VALUES // 10
        rows = rows.withColumns({at: id_order(id_column), mark: F.xxhash64(text_column)})
        rows = rows.join(F.broadcast(per_row) if few else per_row, (F.col(at) == F.col("i_")) & (F.col(mark) == F.col("m_")), "left")
    else:
        rows = rows.withColumn(over, F.lit(None).cast("map<string, int>"))

    def drawn(e: Column) -> Column:
        attempt = F.coalesce(F.element_at(F.col(over), F.concat_ws("|", e["kind"], e["value"])), F.lit(0))
        return F.struct(e["kind"].alias("kind"), e["mention"].alias("mention"), surrogate(e["kind"], e["value"], attempt, key).alias("made"))

    def worded(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), dressed(e["kind"], e["mention"], e["made"], key).alias("surrogate"))

    # Two steps: the surrogate stands once in the plan and is drawn once, not again for every character of the mention.
    entities = F.transform(F.transform(found_name, drawn), worded)
    kept = [c for c in docs.columns if c.lower() != "entities"]
    rows = rows.select(*kept, sought, entities.alias(at))
    gaps = F.split(F.col(text_column), F.col(sought), -1)
    new = F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(at), i)["surrogate"], F.lit("")))), "")
    text = F.when(F.size(at) > 0, new).otherwise(F.col(text_column))
    return rows.select(*[text.alias(c) if c == text_column else F.col(c) for c in kept], F.col(at).alias("entities"))
