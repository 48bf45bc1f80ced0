"""PII surrogates (operator 7) with DataFrame functions only.

Detection: e-mail addresses, phone numbers, IPv4 addresses, card-like numbers
of 13 to 19 digits, social security numbers, secrets (long hexadecimal strings
and the usual key prefixes, of any length) and personal names after a title: any
run of capitalised words, hyphenated ones and initials.  A word of a name found
after a title (each part of a hyphenated one, and initials with their dots) is
also replaced where it stands alone in the same text; a single letter without a
dot stays, as it may be a word.

Every distinct entity gets one surrogate, derived from a keyed SHA-256 of
(type, entity, attempt): letters stay letters of the same script, digits
digits, punctuation stays; a phone number keeps its country code, an e-mail
address its last domain label, a card number its Luhn validity, a key its
prefix; names keep script and the gender that the title shows.  Entities are
compared in a normal form (lower case; digits only for numbers), so all
mentions of one agree, and each mention keeps its own case and separators.

Collision checks: a surrogate must differ from every other surrogate of its
type and from every entity found.  Of entities with the same surrogate the
least keeps it, the others take the next attempt, until none is left; late
attempts at names, initials, e-mail addresses and phone numbers widen the form
(more letters or digits), so this ends even where a short form is used up.  The other
kinds have at least 2^32 forms and keep theirs.

``replace`` returns the rows of ``docs``, all columns, with the text replaced
(and n_chars, where there is one).  ``entities`` lists what was found.
Defined cases: null and empty texts stay as they are; repeated rows get equal
results; an empty table gives an empty result.  Column names that begin with
``_pii`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import NULL_ID
from rosterspark.session import materialize

KEY = "rosterspark"

# Patterns (Java syntax), titles by gender, name syllables by script.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?<![\p{L}\p{N}])(?:sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-fA-F]{32,}+)(?![\p{L}\p{N}]))"
IP = r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])"
SSN = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
PHONE = (r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
         r"|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\p{L}\p{N}])")
PATTERN = "|".join((EMAIL, SECRET, IP, SSN, PHONE, CARD))
MALE, FEMALE, NEUTRAL = ("Mr", "Herr", "Monsieur", "Señor", "Sr"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"), ("Dr", "Prof")
MORE = r"(?:['’]\p{Lu}\p{L}+)*"  # the rest of a name such as O'Brien
INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*"
UNIT = rf"(?:{INITIALS}-?|\p{{Lu}}(?:\p{{L}}|['’]\p{{Lu}}\p{{L}})\p{{L}}*{MORE}(?:-\p{{L}}+{MORE})*|\p{{Lu}}(?= \p{{Lu}}))"
TITLE = rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? {UNIT}(?: ?{UNIT})*+"
NAME = r"\p{L}+" + MORE
QUICK = r"[0-9@]|(?<!\p{L})(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? \p{Lu}|[0-9a-fA-F]{32}|sk-|xox|AKIA|gh[pousr]_"
SYLLABLES = {
    "latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu va",
    "cyrillic": "ба ве ди жо гу за ле ки ло му на пе ри со ту фа",
    "greek": "βα γε δι ζο θυ κα λε μι νο ξυ πα ρε σι το φυ χα",
}
ENDINGS = {"latin": ("n", "a", "l"), "cyrillic": ("н", "я", "к"), "greek": ("ς", "η", "ν")}  # male, female, neutral


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _names(text: Column) -> Column:
    """Words of the names after titles in a text, without the titles."""
    found = F.regexp_extract_all(text, F.lit(TITLE), F.lit(0))
    words = F.transform(found, lambda x: F.regexp_extract_all(F.regexp_replace(x, "^[^ ]+ ", ""), F.lit(rf"{INITIALS}|{NAME}"), F.lit(0)))
    return F.filter(F.array_distinct(F.flatten(words)), lambda x: F.length(x) > 1)


def _pattern(names: Column) -> Column:
    """The pattern of a text: the fixed one, and its own names."""
    return F.when(F.size(names) == 0, F.lit(PATTERN)).otherwise(
        F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(F.transform(names, lambda x: F.concat(
            F.lit(r"\Q"), x, F.when(x.endswith("."), F.lit(r"\E(?!-?\p{Lu}\.)")).otherwise(F.lit(r"\E(?!\p{L})")))), "|"), F.lit(")")))


def found(docs: DataFrame) -> DataFrame:
    """_pii_id, _pii_key, names, titled, mentions (in order) of the texts that have any; one row per distinct (doc_id, text)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_pii_id"), F.xxhash64(_text()).alias("_pii_key"), _text().alias("t"))
    rows = rows.filter(F.col("t").rlike(QUICK))
    rows = rows.select("_pii_id", "_pii_key", "t", _names(F.col("t")).alias("names"))
    rows = rows.select("_pii_id", "_pii_key", "names",
                       F.when(F.size("names") > 0, F.regexp_extract_all("t", F.lit(TITLE), F.lit(0))).alias("titled"),
                       F.regexp_extract_all(F.col("t"), _pattern(F.col("names")), F.lit(0)).alias("mentions"))
    return rows.filter(F.size("mentions") > 0).dropDuplicates(["_pii_id", "_pii_key"])


def _kind(m: Column) -> Column:
    has = lambda p: m.rlike("^(?:" + p + ")$")
    return (F.when(m.contains("@"), "email").when(m.rlike("^[0-9a-fA-F]{32,}$"), "hex").when(has(IP), "ip").when(has(SSN), "ssn")
            .when(has(PHONE), "phone").when(has(CARD), "card").when(m.rlike(rf"^{NAME}$"), "name")
            .when(m.rlike(rf"^{INITIALS}$"), "initials").otherwise("key"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _normal(kind: Column, m: Column) -> Column:
    """The form in which mentions are compared; a phone number: country code, a bar, the other digits."""
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1)
    phone = F.concat(code, F.lit("|"), F.substring(_digits(m), F.length(code) + 1, F.lit(64)))
    return (F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "key", m).otherwise(F.lower(m)))


def _shape(text: Column, h: Column) -> Column:
    """Text with every letter and digit replaced by one of its kind, chosen by the characters of the hash h (worked out once)."""
    return F.element_at(F.transform(F.array(h), lambda once: _shaped(text, once)), 1)


def _shaped(text: Column, h: Column) -> Column:
    draw = lambda i: F.ascii(F.substring(h, i % 128 + 1, F.lit(1))) * 7 + F.ascii(F.substring(h, (i * 3 + 5) % 128 + 1, F.lit(1)))
    pick = lambda letters, i: F.substring(F.lit(letters), (F.pmod(draw(i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
        F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i))
        .when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", i)).when(c.rlike(r"\p{IsLatin}"), pick("àáâãäåèéêëìíîïòóôõöùúûü", i))
        .otherwise(c))), "")


def _luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(d)
    return F.aggregate(F.transform(F.split(d, ""), lambda c, i: F.when(
        (n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x)


def _surrogate(key: str) -> Column:
    """The surrogate of columns kind, entity, gender, attempt, in normal form."""
    kind, e, attempt = F.col("kind"), F.col("entity"), F.col("attempt")
    part = lambda k: F.sha2(F.concat_ws("|", F.lit(key), kind, e, attempt.cast("string"), F.lit(str(k))).cast("binary"), 256)
    h = F.concat(part(0), part(1))
    number = F.translate(h, "abcdef", "012345")
    wide = lambda fill: F.when(attempt > 8, F.substring(fill, 1, F.least(attempt - 8, F.lit(64)))).otherwise("")
    take = lambda n: F.substring(number, F.lit(1), n)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    last = F.substring_index(domain, ".", -1)
    email = F.concat(_shape(local, h), wide(F.translate(part(2), "0123456789", "ghijklmnop")), F.lit("@"),
                     _shape(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), part(3)), last)
    octet = lambda k: (F.conv(F.substring(part(4), 4 * k + 1, 4), 16, 10).cast("int") % 256).cast("string")
    code = F.substring_index(e, "|", 1)
    phone = F.concat(code, F.lit("|"), take(F.length(e) - F.length(code) - 1 + F.greatest(attempt - 8, F.lit(0))))
    body = take(F.length(e) - 1)
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn_sum(e) % 10 == 0, F.concat(body, check)).otherwise(take(F.length(e)))
    prefix = F.regexp_extract(e, r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-)", 1)
    secret = F.concat(prefix, _shape(F.substring(e, F.length(prefix) + 1, F.length(e)), h))
    hexadecimal = F.substring(F.repeat(h, F.ceil(F.length(e) / 128).cast("int")), F.lit(1), F.length(e))
    initials = F.concat(F.substring(F.translate(part(2), "0123456789", "ghijklmnop"), F.lit(1), F.least(attempt, F.lit(64))), _shape(e, h))

    def name(script):
        sounds = F.split(F.lit(SYLLABLES[script]), " ")
        sound = lambda k: F.get(sounds, F.conv(F.substring(h, k, 1), 16, 10).cast("int"))
        m, f, n = ENDINGS[script]
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1)).cast("int")), lambda i: F.when(
            i < 2, F.lit("")).otherwise(F.get(sounds, F.conv(F.substring(part(5), i % 64 + 1, F.lit(1)), 16, 10).cast("int")))), "")
        return F.concat(sound(1), sound(2), sound(3), sound(4), more, F.when(F.col("gender") == "m", m).when(F.col("gender") == "f", f).otherwise(n))
    names = F.when(e.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(e.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return (F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))
            .when(kind == "hex", hexadecimal).when(kind == "phone", phone)
            .when(kind == "card", card).when(kind == "ssn", take(F.lit(9))).when(kind == "name", names)
            .when(kind == "initials", initials).otherwise(secret))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate) for a table of distinct (kind, entity, gender): collision-free (module docstring)."""
    now = materialize(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)), "surrogates")
    originals = entities.select(F.col("kind"), F.col("entity").alias("surrogate"), F.lit(True).alias("taken"))
    while True:
        same = Window.partitionBy("kind", "surrogate").orderBy("entity")
        marked = (now.join(originals, ["kind", "surrogate"], "left").withColumn("nth", F.row_number().over(same))
                  .withColumn("clash", (F.col("nth") > 1) | F.col("taken").isNotNull()).drop("nth", "taken"))
        marked = materialize(marked, "surrogates")
        if marked.filter("clash").isEmpty():
            return marked.select("kind", "entity", "surrogate")
        again = marked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        now = materialize(again.select("kind", "entity", "gender", "attempt", F.when(F.col("clash"), _surrogate(key)).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")


def _as_written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the mention: separators of numbers, case of words."""
    digits = F.regexp_replace(surrogate, r"[^0-9]", "")
    place = lambda i: F.length(_digits(F.substring(mention, F.lit(1), i + 1)))
    number = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")
    number = F.concat(number, F.substring(digits, F.length(_digits(mention)) + 1, F.lit(128)))  # a widened phone number
    word = (F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate))
            .when(F.substring(mention, 1, 1) != F.lower(F.substring(mention, 1, 1)), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
            .otherwise(surrogate))
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind.isin("email", "hex", "name", "initials"), word).otherwise(surrogate)


def _mentions(hits: DataFrame) -> DataFrame:
    """Distinct mentions of each text, typed: _pii_id, _pii_key, mention, kind, entity, gender."""
    m = hits.select("_pii_id", "_pii_key", "titled", F.explode(F.array_distinct("mentions")).alias("mention"))
    gender = lambda titles: F.exists(F.col("titled"), lambda x: (F.array_contains(F.array(*map(F.lit, titles)), F.regexp_extract(x, r"^\p{L}+", 0)))
                                     & (F.size(F.split(x, " ")) > 2) & F.array_contains(F.split(F.get(F.split(x, " "), 1), "-"), F.col("mention")))
    m = m.withColumn("kind", _kind(F.col("mention"))).withColumn("entity", _normal(F.col("kind"), F.col("mention")))
    named = F.col("kind") == "name"
    return m.withColumn("gender", F.when(named & gender(MALE), "m").when(named & gender(FEMALE), "f")).drop("titled")


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, mention, kind, entity of every distinct mention of every distinct document."""
    return _mentions(found(docs)).select(F.when(F.col("_pii_id") != NULL_ID, F.col("_pii_id")).alias("doc_id"), "mention", "kind", "entity")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with every mention replaced by its surrogate (module docstring)."""
    hits = materialize(found(docs), "pii-found")
    mentions = materialize(_mentions(hits), "pii-mentions")
    distinct = materialize(mentions.groupBy("kind", "entity").agg(F.min("gender").alias("gender")), "pii-entities")
    table = surrogates(distinct, key)
    written = mentions.join(table, ["kind", "entity"]).select(
        "_pii_id", "_pii_key", F.struct("mention", _as_written(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("written")).alias("m"))
    per_text = written.groupBy("_pii_id", "_pii_key").agg(F.map_from_entries(F.collect_list("m")).alias("_pii_map"))
    plan = materialize(hits.select("_pii_id", "_pii_key", F.col("names").alias("_pii_names"), F.col("mentions").alias("_pii_mentions"))
                       .join(per_text, ["_pii_id", "_pii_key"]), "pii-plan")
    keyed = docs.withColumn("_pii_key2", F.xxhash64(_text())).withColumn("_pii_id2", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    joined = keyed.join(plan, (F.col("_pii_id2") == F.col("_pii_id")) & (F.col("_pii_key2") == F.col("_pii_key")), "left")
    rest = F.split(F.col("text"), _pattern(F.col("_pii_names")), F.lit(-1))
    new = F.concat(F.element_at(rest, 1), F.array_join(F.transform(
        F.col("_pii_mentions"), lambda m, i: F.concat(F.element_at(F.col("_pii_map"), m), F.get(rest, i + 1))), ""))
    joined = joined.withColumn("_pii_new", F.when(F.col("_pii_map").isNull(), F.col("text")).otherwise(new))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_pii_new").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("_pii_map").isNull(), F.col("n_chars")).otherwise(F.length("_pii_new").cast(dict(docs.dtypes)["n_chars"])).alias("n_chars"))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
