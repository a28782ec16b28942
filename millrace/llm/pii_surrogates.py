"""Personal data replaced by keyed surrogates, with column expressions only.

One pattern finds entities: mail addresses, IPv4 addresses, payment cards (with a
valid check digit), social security numbers, phone numbers, account numbers and names
after a title. Each entity is replaced by one of its type that is drawn from an HMAC-like
hash of a secret key and the entity's canonical form, so every mention of an entity, in
whatever document and format, gets the same surrogate:

* digits are drawn from the right, and separators stay where they were, so a number
  with and without its country code agrees; cards end in a valid check digit;
* addresses are drawn from reserved ranges (class E, example domains);
* names keep titles, hyphens, particles ("van", "de la"), prefixes ("Mc", "O'") and capitals;
  their words are made of syllables of the same script and end by the gender of the
  title; surnames and given names are entities of their own, so "Mr A B", "MR. B" and
  "Mr. B-C" agree and two names differ wherever their words do. Initials of the Latin,
  Cyrillic and Greek alphabets are exchanged by a keyed rotation. In a text that names a
  person with a title, the bare surname and given names are replaced as well.

Not found are persons without a title, names of initials only, titles in capitals other
than ``_CAPITALS``, more than three words of a name (two where it is all in capitals),
bare names in other capitals than behind the title, initials before bare names, IPv6
addresses, numbers of seven digits without a word such as "call" before them, and phone
numbers whose groups are neither the North American ones nor behind a plus sign nor one
of ``NATIONAL``. Words in capitals right behind a name are taken as part of it. A number
with a trunk zero is an entity of its own beside the one with a country code, and digits
before a number's last ten stay.

Before anything is replaced, all distinct entities and their surrogates are checked
against each other: two entities with one surrogate, or a surrogate that some text
really holds, make the later entity draw again, until no clash is left. A name gets one
syllable more with each draw, so names do not run out. Addresses can: there are 2.5e8
surrogates for IPv4 and 1e8 for social security numbers, and a run ends in an error
when ``MAX_DRAWS`` draws leave a clash.

Defined cases: a null text stays null; empty texts and texts without entities stay as
they are; numbers of card length without a valid check digit are no entities; repeated
rows are replaced alike; an empty table gives an empty result; other columns are kept, and
one named ``n_entities`` is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import discard, shuffle_partitions, stage

#: Key of the surrogates; give another in production.
KEY = "millrace"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,20}(?<=\.[A-Za-z]{2,24})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: A plus sign and 7 to 15 digits, two marks at most between them.
ABROAD = r"(?<![0-9A-Za-z+.])\+[0-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z]|\.[0-9])"
#: Numbers with a trunk zero: five pairs, or an area code and one or two groups.
NATIONAL = r"(?<![0-9A-Za-z+.,/-])0(?:[1-9](?:[ .-][0-9]{2}){4}|[0-9]{2,4}[ /-][0-9]{5,7}|[0-9]{2,3}[ /-](?:[0-9]{8}|[0-9]{3,4}[ -][0-9]{3,4}))(?![0-9A-Za-z]|[.,/-][0-9])"
LOCAL = r"(?<=(?:[Cc]all|[Pp]hone|[Tt]el|[Ff]ax|[Mm]obile)[:.]{0,1} )[0-9]{3}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
#: Titles by gender; the rest of ``TITLES`` tells none.
MALE = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа", "Κυρία"]
TITLES = [*MALE, *FEMALE, "Dr", "Prof"]
_LATIN, _CYRILLIC, _GREEK = r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}"
#: Titles in capitals (the last ones only before a mark), degrees behind a title, particles and prefixes of surnames.
_CAPITALS, _MARKED_CAPITALS = ["MRS", "MR", "HERR", "FRAU"], ["MS", "DR", "PROF", "MME", "MLLE", "SRA", "SR"]
_DEGREES = ["med", "jur", "phil", "rer", "nat", "ing"]
PARTICLES = ["van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "los", "ten", "ter", "zu", "zur", "af", "av", "al", "el", "bin", "ibn"]
PREFIXES = ["Mc", "Mac", "Fitz", "De", "Del", "Di", "Da", "Du", "La", "Le", "Van", "Von"]
_LETTER, _END = r"[\p{L}\p{M}]", r"(?![\p{L}\p{M}])"
_TITLE = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(sorted([*TITLES, *_CAPITALS], key=len, reverse=True))})\.?|(?:{'|'.join(_MARKED_CAPITALS)})\.)"
    rf"(?: (?:Dr|Prof|DR|PROF)\.?{_END}| (?:{'|'.join(_DEGREES)})\.){{0,4}}+"
)
#: What may stand before a word of a name: initials and particles.
_BEFORE = rf"(?:\p{{Lu}}\. ?|(?:{'|'.join(PARTICLES)})[ -]|d['’]){{0,4}}"
_INNER = r"['’](?=\p{Lu}\p{L})"
_MIXED = rf"{_BEFORE}\p{{Lu}}(?=[\p{{L}}\p{{M}}'’]{{0,30}}\p{{Ll}})(?:{_INNER}|{_LETTER}){{1,30}}{_END}"
_CAPS = rf"{_BEFORE}\p{{Lu}}(?:{_INNER}|[\p{{Lu}}\p{{M}}]){{1,30}}{_END}"
NAME = rf"{_TITLE} (?:{_MIXED}(?:[ -]{_MIXED}){{0,2}}|{_CAPS}(?:[ -]{_CAPS}){{0,1}})"
#: A word of a found name, the rest being titles, initials, particles and marks; and a prefix with what it stands before.
WORD = r"\p{Lu}[\p{L}\p{M}'’]+"
_CORE = rf"^(?:{'|'.join(PREFIXES)}|\p{{Lu}}['’])?(\p{{Lu}}[\p{{L}}\p{{M}}'’]+)$"
ENTITY = "|".join([MAIL, IPV4, CARD, SSN, PHONE, ABROAD, NATIONAL, LOCAL, IBAN, NAME])
#: A text without these holds no entity: every number of ``ENTITY`` has a plus sign, or two digits with one mark at most between them.
HINT = r"[0-9][. -]?[0-9]|@|\+[0-9]|" + _TITLE + " " + _BEFORE + r"\p{Lu}"
#: The alphabets of initials.
ALPHABETS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Letters that syllables of a script are made of, and endings by gender (male, female, unknown).
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("o", "a", "e"), ("son", "son", "son")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("ий", "ия", "е"), ("ов", "ова", "ко")),
    "greek": ("βγδζκλμνπρστ", "αεηιο", ("ος", "α", "ι"), ("ης", "η", "ου")),
}
#: Times that clashing entities may draw again before the run stops with an error.
MAX_DRAWS = 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(h: Column, at: int, below: int) -> Column:
    """The ``at``-th number below ``below`` drawn from a hash of 128 hex digits (four a number, so 32 of them)."""
    return F.conv(F.substring(h, at * 4 + 1, 4), 16, 10).cast("int") % F.lit(below)


def _drawn(kind: Column, canonical: Column, draw: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canonical, draw.cast("string"), F.lit(key)), 512)


def luhn_sum(digits: Column) -> Column:
    """Check sum of a string of digits; a valid number has a multiple of 10."""
    n = F.length(digits)
    doubled = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * 2
    value = lambda i: F.when(i % 2 == 1, F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))).otherwise(F.substring(digits, n - i, F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))


def kind_of(e: Column) -> Column:
    """Type of an entity, null for a number of card length that fails its check."""
    long = F.length(_digits(e)) >= 13
    plain = F.coalesce(e.rlike(r"^[0-9 -]+$"), F.lit(False))
    return (
        F.when(e.contains("@"), "mail")
        .when(e.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & ~e.rlike(r"[0-9]{4}"), "ip")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(plain & long, F.when(luhn_sum(_digits(e)) % 10 == 0, "card"))
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), "account")
        .when(e.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def surname(e: Column) -> Column:
    return F.regexp_extract(e, f"({WORD})$", 1)


def core(word: Column) -> Column:
    """A word of a name without its prefix."""
    found = F.regexp_extract(word, _CORE, 1)
    return F.when(found == "", word).otherwise(found)


def respelt(word: Column, made: Column) -> Column:
    """``made`` in the place of a word's core: behind its prefix, in its capitals."""
    before = F.substring(word, F.lit(1), F.length(word) - F.length(core(word)))
    return F.concat(before, F.when(core(word).rlike(r"\p{Ll}"), made).otherwise(F.upper(made)))


def initials(text: Column, key: str) -> Column:
    """Capitals of ``ALPHABETS`` exchanged for others, each for one of its own."""
    for letters in ALPHABETS:
        by = 1 + int(hashlib.sha256(f"{key}:{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        text = F.translate(text, letters, letters[by:] + letters[:by])
    return text


def canonical(e: Column, kind: Column) -> Column:
    """What all mentions of an entity share."""
    return (
        F.when(kind == "mail", F.lower(e))
        .when(kind == "ip", e)
        .when(kind == "phone", F.right(_digits(e), F.lit(10)))
        .when(kind == "account", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.lower(core(surname(e))))
        .otherwise(_digits(e))
    )


def _refilled(e: Column, digits: Column) -> Column:
    """``e`` with its digits replaced in order by ``digits``."""
    return F.array_join(F.zip_with(F.split(e, "[0-9]", -1), F.split(F.concat(digits, F.lit("#")), ""), lambda between, digit: F.concat(between, F.replace(digit, F.lit("#"), F.lit("")))), "")


def _numbers(h: Column, n: Column | int) -> Column:
    """A string of n digits, 34 at most, whose k-th from the right depends on h and k only."""
    half = lambda at: F.right(F.lpad(F.conv(F.substring(h, at, 15), 16, 10), 18, "0"), F.lit(17))
    return F.right(F.concat(half(16), half(1)), n if isinstance(n, Column) else F.lit(n))


def _last_ten(e: Column, h: Column) -> Column:
    """A phone number's digits: those before the last ten stay (a country code), the rest are drawn."""
    d = _digits(e)
    n = F.least(F.length(d), F.lit(10))
    return F.concat(F.substring(d, F.lit(1), F.length(d) - n), _numbers(h, n))


def _card(e: Column, h: Column) -> Column:
    """Digits that start with an unassigned 9 and end in a valid check digit."""
    body = F.concat(F.lit("9"), _numbers(h, F.length(_digits(e)) - 2))
    return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


#: Letters by kind, and what stands for each kind in a mask.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MASK = "a" * 26 + "A" * 26 + "0" * 10


def _letters(text: Column, h: Column) -> Column:
    """Letters and digits replaced by drawn ones of the same kind (of 16 letters), the rest kept; by place in the text, repeating after 128."""
    letters = F.translate(h, _DIGITS, "qrstuvwxyz")
    bound = F.struct(F.split(text, "").alias("old"), F.split(F.translate(text, _LOWER + _UPPER + _DIGITS, _MASK), "").alias("mask"), F.split(letters, "").alias("lower"), F.split(F.upper(letters), "").alias("upper"), F.split(F.translate(h, "abcdef", "024689"), "").alias("digits"))
    one = lambda s, i: F.when(s["mask"][i] == "a", s["lower"][i % 128]).when(s["mask"][i] == "A", s["upper"][i % 128]).when(s["mask"][i] == "0", s["digits"][i % 128]).otherwise(s["old"][i])
    # The lists are bound to a variable, so they are made once a text.
    made = F.transform(F.array(bound), lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["old"]) - 1), lambda i: one(s, i)), ""))[0]
    return F.when(F.length(text) > 0, made).otherwise(F.lit(""))


def _mail(e: Column, h: Column) -> Column:
    """A local part of the same form at a host below an example domain."""
    local = F.substring_index(e, "@", 1)
    top = F.element_at(F.array(*[F.lit(x) for x in ("com", "net", "org")]), _number(h, 31, 3) + 1)
    return F.concat(_letters(F.lower(local), h), F.lit("@m"), F.substring(h, 101, 10), F.lit(".example."), top)


def _ip(h: Column) -> Column:
    return F.concat_ws(".", (_number(h, 0, 15) + 240).cast("string"), *[_number(h, k, 256).cast("string") for k in (1, 2, 3)])


def script_of(word: Column) -> Column:
    return F.when(word.rlike(f"^{_CYRILLIC}"), "cyrillic").when(word.rlike(f"^{_GREEK}"), "greek").otherwise("latin")


def gender_of(e: Column) -> Column:
    """Place in a triple of endings: male, female, unknown."""
    title = F.lower(F.regexp_extract(e, r"^(\S+?)\.? ", 1))
    return F.when(title.isin([t.lower() for t in MALE]), 0).when(title.isin([t.lower() for t in FEMALE]), 1).otherwise(2)


def _by_script(word: Column, of) -> Column:
    """A constant by the script of a word."""
    chosen = None
    for script, letters in SCRIPTS.items():
        chosen = F.when(script_of(word) == script, of(letters)) if chosen is None else chosen.when(script_of(word) == script, of(letters))
    return chosen


def name_stem(h: Column, draw: Column, word: Column) -> Column:
    """A capitalised stem of the word's script: three syllables, one more a draw (six at most), and a consonant."""
    letters = _by_script(word, lambda x: F.array(F.lit(x[0]), F.lit(x[1])))

    def spelt(drawn: Column, of: Column) -> Column:
        take = lambda k: F.substring(of[k % 2], F.conv(F.substring(drawn, k * 4 + 1, 4), 16, 10).cast("int") % F.length(of[k % 2]) + 1, F.lit(1))
        more = [F.when(draw > j, F.concat(take(6 + 2 * j), take(7 + 2 * j))).otherwise("") for j in range(6)]
        return F.concat(F.upper(take(0)), *[take(k) for k in range(1, 6)], *more, take(20))

    # The letters are bound to a variable, so they are chosen once.
    return F.transform(F.array(letters), lambda of: spelt(h, of))[0]


def name_forms(stem: Column, word: Column, kind: Column) -> Column:
    """The name by gender: male, female, unknown. Endings differ by kind and the stem alone tells names apart."""
    ends = lambda k: _by_script(word, lambda x: F.array(*[F.lit(e) for e in x[k]]))
    endings = F.when(kind == "given", ends(2)).otherwise(ends(3))
    return F.transform(F.array(stem), lambda s: F.transform(endings, lambda e: F.concat(s, e)))[0]


def surrogate(e: Column, kind: Column, h: Column, draw: Column) -> Column:
    """The surrogates of a mention whose entity drew ``h``: one, or for names one a gender."""
    one = (
        F.when(kind == "mail", _mail(e, h))
        .when(kind == "ip", _ip(h))
        .when(kind == "card", _refilled(e, _card(e, h)))
        .when(kind == "ssn", _refilled(e, F.concat(F.lit("9"), _numbers(h, 8))))
        .when(kind == "phone", _refilled(e, _last_ten(e, h)))
        .when(kind == "account", F.concat(F.substring(e, 1, 2), _letters(F.substring(e, F.lit(3), F.length(e) - 2), h)))
    )
    return F.when(kind.isin("name", "given"), name_forms(name_stem(h, draw, e), e, kind)).otherwise(F.array(one))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks: surrogates cost more than their few bytes tell."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def settled(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, h, draw) with draws that do not clash, for entities (kind, canonical, mention).

    In each round a surrogate's canonical form is held by the entity with the fewest
    draws, then the first by name, unless an original holds it; all others draw again.
    Surnames and given names are checked together, in all their forms.
    """
    sort = lambda kind: F.when(kind.isin("name", "given"), "word").otherwise(kind)
    hashed = lambda df: df.withColumn("h", _drawn(F.col("kind"), F.col("canonical"), F.col("draw"), key))
    current = stage(hashed(entities.withColumn("draw", F.lit(0))), "draws")
    for _ in range(MAX_DRAWS):
        forms = spread(current, "kind", "canonical").select("kind", "canonical", "draw", F.explode(surrogate(F.col("mention"), F.col("kind"), F.col("h"), F.col("draw"))).alias("made"))
        drawn = stage(forms.select("kind", "canonical", "draw", sort(F.col("kind")).alias("sort"), F.when(F.col("kind").isin("name", "given"), F.lower("made")).otherwise(canonical(F.col("made"), F.col("kind"))).alias("value")), "made")
        real = current.select(sort(F.col("kind")).alias("sort"), F.col("canonical").alias("value"), F.lit(True).alias("real")).distinct()
        held = drawn.groupBy("sort", "value").agg(F.min(F.struct("draw", "kind", "canonical")).alias("holder"), F.count("*").alias("n"))
        taken = held.join(real, ["sort", "value"], "left").filter(F.col("real") | (F.col("n") > 1)).select("sort", "value", F.when(F.col("real").isNull(), F.struct("holder.kind", "holder.canonical")).alias("holder"))
        lost = drawn.join(taken, ["sort", "value"]).filter(~F.coalesce(F.struct("kind", "canonical") == F.col("holder"), F.lit(False)))
        lost = stage(lost.select("kind", "canonical", F.lit(True).alias("again")).distinct(), "clashes")
        discard(drawn)
        if lost.isEmpty():
            return current.select("kind", "canonical", "h", "draw")
        redrawn = current.join(lost, ["kind", "canonical"], "left").select("kind", "canonical", "mention", (F.col("draw") + F.when(F.col("again"), 1).otherwise(0)).alias("draw"))
        after = stage(hashed(redrawn), "draws")
        discard(current, lost)
        current = after
    raise RuntimeError(f"entities clash after {MAX_DRAWS} draws")


def find_entities(docs: DataFrame) -> DataFrame:
    """(__id, __text, found) of each text with entities; staged."""
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    rows = docs.filter(hinted).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found"))
    return stage(rows.filter(F.size("found") > 0), "found")


def after_title(e: Column) -> Column:
    return F.regexp_replace(e, f"^{_TITLE} ", "")


def given_names(e: Column) -> Column:
    """(word, kind) of the words before the last; those that a hyphen joins to it are surnames too."""
    words_of = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    words, last = words_of(after_title(e)), words_of(F.substring_index(after_title(e), " ", -1))
    first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(first, lambda w, i: F.struct(w.alias("word"), F.when(i < F.size(words) - F.size(last), "given").otherwise("name").alias("kind")))


def made_mentions(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(mention, kind, made, words) of staged mentions (mention, kind, canonical): the surrogate, and of a name each old and new word."""
    words = mentions.filter("kind = 'name'").select("mention", F.posexplode(given_names(F.col("mention"))).alias("nth", "w"))
    words = stage(words.select("mention", "nth", "w.word", F.lower(core(F.col("w.word"))).alias("canonical"), "w.kind"), "given-names")
    whole = mentions.select("kind", "canonical", F.when(F.col("kind") == "name", core(surname(F.col("mention")))).otherwise(F.col("mention")).alias("mention"))
    every = whole.unionByName(words.select("kind", "canonical", core(F.col("word")).alias("mention")))
    drawn = settled(every.groupBy("kind", "canonical").agg(F.min("mention").alias("mention")), key)
    form = lambda word: surrogate(word, F.col("kind"), F.col("h"), F.col("draw"))
    renamed = lambda word: F.struct(word.alias("old"), respelt(word, form(core(word))[gender_of(F.col("mention"))]).alias("new"))
    parts = spread(words.join(drawn, ["kind", "canonical"]), "mention").select("mention", F.struct("nth", renamed(F.col("word")).alias("w")).alias("part"))
    given = parts.groupBy("mention").agg(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["w"]).alias("given"))
    met = spread(mentions.join(drawn, ["kind", "canonical"]).join(given, "mention", "left"), "mention")
    last = renamed(surname(F.col("mention")))
    named = F.concat(F.coalesce(F.col("given"), F.array().cast("array<struct<old:string,new:string>>")), F.array(last))
    bound = met.withColumn("words", F.when(F.col("kind") == "name", named))
    title = F.regexp_extract("mention", f"^{_TITLE} ", 0)
    between = F.split(after_title(F.col("mention")), WORD, -1)
    spelt = F.zip_with(between, F.concat(F.transform("words", lambda w: w["new"]), F.array(F.lit(""))), lambda b, w: F.concat(initials(b, key), w))
    made = F.when(F.col("kind") == "name", F.concat(title, F.array_join(spelt, ""))).otherwise(form(F.col("mention"))[0])
    return bound.select("mention", "kind", made.alias("made"), "words")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` replaced and ``n_entities`` added."""
    found = find_entities(docs)
    mentions = found.select(F.explode("found").alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention"))).filter("kind is not null")
    mentions = stage(mentions.withColumn("canonical", canonical(F.col("mention"), F.col("kind"))), "mentions")
    made = stage(made_mentions(mentions, key), "surrogates")
    # One row for each text with entities; rows that repeat doc_id and text share it.
    held = found.select("__id", "__text", F.explode(F.array_distinct("found")).alias("mention")).distinct().join(made, "mention")
    per = held.groupBy("__id", "__text").agg(F.map_from_entries(F.collect_list(F.struct("mention", "made"))).alias("__made"), F.flatten(F.collect_list("words")).alias("__names"))
    per = stage(per.join(found.dropDuplicates(["__id", "__text"]).withColumnRenamed("found", "__found"), ["__id", "__text"]), "replacements")
    same = docs["doc_id"].eqNullSafe(per["__id"]) & (F.xxhash64(docs["text"]) == per["__text"])
    read = docs.join(per.hint("merge"), same, "left")
    value = F.transform(per["__found"], lambda e: F.coalesce(per["__made"][e], e))
    joined = F.array_join(F.zip_with(F.split(docs["text"], ENTITY, -1), F.concat(value, F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")
    whole = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), w, F.lit(r"(?![\p{L}\p{N}])"))
    bare = F.aggregate(F.array_sort(F.array_distinct(per["__names"])), joined, lambda text, x: F.regexp_replace(text, whole(x["old"]), x["new"]))
    n = F.size(F.filter(per["__found"], lambda e: per["__made"][e].isNotNull()))
    text = F.when(per["__made"].isNull(), docs["text"]).otherwise(bare)
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c != "n_entities"]
    return read.select(*columns, F.when(per["__made"].isNull(), 0).otherwise(n).cast("long").alias("n_entities"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_entities")
