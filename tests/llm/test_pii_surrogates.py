import re

from pyspark.sql import functions as F

from millrace.llm.pii_surrogates import ENTITY, HINT, TITLES, replace_entities, settled, surrogate
from tests.llm.helpers import EDGES, edges, empty

TEXTS = [
    (1, "Mail Bob.x9@Mail7.example.com or bob.x9@mail7.example.com, call +1 (017) 555-7713 or (017) 555-7713; 4111 1111 1111 1111"),
    (2, "Mr. John Smith met Mrs Anna-Maria Smith and Smith. Frau Müller; г-жа Иванова, Κύριος Παπάς"),
    (3, "from 97.51.17.173 not card 4111111111111112 but 5500005555555559, ssn 123-45-6789, DE89 3704 0044 0532 0130 00"),
    (4, "again bob.x9@mail7.example.com and Mr Smith"),
]


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_types_formats_and_coreference(spark):
    found = {r.doc_id: r for r in replace_entities(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()}
    one = re.fullmatch(r"Mail (\S+@\S+) or (\S+@\S+), call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}); ((?:\d{4} ?){4})", found[1].text)
    assert one and one[1] == one[2] and one[3] == one[4] and luhn(one[5]) and found[1].n_entities == 5
    assert not any(old in r.text for r in found.values() for old in ("x9@mail7", "555-7713", "Smith", "Müller", "Иванова", "Παπάς", "97.51", "5500005555555559", "123-45", "3704"))
    names = re.fullmatch(r"Mr\. ([A-Z]\w+) ([A-Z]\w+) met Mrs (\w+)-(\w+) (\w+) and (\w+)\. Frau (\w+); г-жа ([А-Я][а-я]+), Κύριος (\w+)", found[2].text)
    assert names and names[2] == names[5] == names[6]
    assert names[1].endswith("o") and names[3].endswith("a") and names[8].endswith("ова") and names[9].endswith("ης")
    assert "4111111111111112" in found[3].text and found[3].n_entities == 4
    assert one[1] in found[4].text and f"Mr {names[2]}" in found[4].text


def test_clashing_draws_are_repeated(spark, monkeypatch):
    import millrace.llm.pii_surrogates as P

    monkeypatch.setattr(P, "_ip", lambda h: F.concat(F.lit("240.0.0."), P._number(h, 0, 64).cast("string")))
    table = spark.createDataFrame([("ip", f"10.0.0.{k}", f"10.0.0.{k}") for k in range(24)] + [("ip", "240.0.0.7", "240.0.0.7")], "kind string, canonical string, mention string")
    drawn = settled(table, "k").join(table, ["kind", "canonical"])
    made = [r.made[0] for r in drawn.select(surrogate(F.col("mention"), F.col("kind"), F.col("h"), F.col("draw")).alias("made")).collect()]
    assert len(set(made)) == 25 and "240.0.0.7" not in made


def test_names_do_not_run_out_and_stay_distinct(spark, monkeypatch):
    import millrace.llm.pii_surrogates as P

    monkeypatch.setattr(P, "SCRIPTS", {k: (c[:2], v[:1], *rest) for k, (c, v, *rest) in P.SCRIPTS.items()})
    first, last = [f"{a}{b}x" for a in "ABCDE" for b in "abcde"], [f"{a}{b}y" for a in "FGHIJKLM" for b in "abcdefg"]
    rows = [(i, f"Mr. {f} {s} met Mrs {f} {s}, and {f} called {s}.") for i, (f, s) in enumerate((f, s) for f in first[:12] for s in last)]
    found = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {k: re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+), and (\w+) called (\w+)\.", t).groups() for k, t in found.items()}
    assert len(names) == len(rows) == len({(n[0], n[1]) for n in names.values()}) == len({(n[2], n[3]) for n in names.values()})
    assert all(n[4] in (n[0], n[2]) and n[5] in (n[1], n[3]) for n in names.values())
    by_first = {t.split()[1]: set() for _, t in rows}
    for k, t in rows:
        by_first[t.split()[1]].add(names[k][0])
    assert all(len(v) == 1 for v in by_first.values())
    originals = {w for _, t in rows for w in t.split()[1:3]}
    assert not originals & {w for n in names.values() for w in n}


#: Texts with one entity each and nothing else that looks like one.
LONE = [
    "at 8.8.8.8 here", "at 1.2.3.4", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 here", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "card 4111111111111111",
    "a@b.cd", "ssn 123-45-6789", "call 555-123-4567", "call (12)345-6789", "call +1 12 345 6789", "DE89 3704 0044 0532", "XX12AAAABBBBCCCC", "+4 4 2 0 7 9 4", "+1(2)3(4)5(6)7", "01 23 45 67 89", "020 79460958", "0171/1234567", "020 7946 0958", "call 555-0199", "Ms. van Dyke", "Mr d’Arcy", "Dr. J. Smith", "MR. SMITH", "Frau Prof. Dr. med. Meyer", *[f"{t} Xyz" for t in TITLES], *[f"{t}. Xyz" for t in TITLES],
]


def test_hint_is_implied_by_entities(spark):
    table = spark.createDataFrame([(t,) for t in LONE], "text string")
    rows = table.select("text", F.col("text").rlike(ENTITY).alias("entity"), F.col("text").rlike(HINT).alias("hint")).collect()
    assert all(r.entity for r in rows) and [r.text for r in rows if not r.hint] == []


def test_single_digits_are_replaced_alike(spark):
    spaced = LONE[2]
    texts = [(1, "the resolver is 8.8.8.8 and the fallback 1.1.1.1 here"), (2, "8.8.8.8 was seen on day 12"), (3, spaced), (4, "card 4111 1111 1111 1111 here")]
    found = {r.doc_id: r for r in replace_entities(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[k].n_entities for k in (1, 2, 3, 4)] == [2, 1, 1, 1]
    one = re.fullmatch(r"the resolver is (\S+) and the fallback (\S+) here", found[1].text)
    assert one and one[1] != one[2] and not {"8.8.8.8", "1.1.1.1"} & {one[1], one[2]}
    assert found[2].text == f"{one[1]} was seen on day 12"
    assert found[3].text != spaced and found[3].text.replace(" ", "") == found[4].text.replace(" ", "")


DIGITS = re.compile(r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])|(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])")


def test_entities_match_brute_force(spark):
    """Over generated texts: what is replaced, in which format, the same everywhere, distinct, and nothing else."""
    import random

    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + number(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    pool = [f"u{number(3)}.{k}@mail{k}.com" for k in range(8)] + [".".join(str(rng.randrange(1, 200)) for _ in range(4)) for _ in range(8)] + [card() for _ in range(8)] + [f"{number(3)}-{number(2)}-{number(4)}" for _ in range(8)]
    spaced = lambda e: " ".join(re.findall("....", e)) if re.fullmatch("[0-9]{16}", e) and rng.random() < 0.5 else e
    rows = [(k, " ; ".join([f"word{k}", *(spaced(rng.choice(pool)) for _ in range(rng.randint(0, 6))), "4111111111111112", "end"])) for k in range(80)]
    plain = lambda e: re.sub("[ -]", "", e) if "@" not in e else e.lower()
    given, used = {}, {}
    for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        old = rows[r.doc_id][1]
        before, after = DIGITS.findall(old), DIGITS.findall(r.text)
        real = [e for e in before if e != "4111111111111112"]
        assert r.n_entities == len(real) and len(before) == len(after) and after[-1] == "4111111111111112"
        assert DIGITS.split(old) == DIGITS.split(r.text)
        for a, b in zip(before, after):
            if a == "4111111111111112":
                continue
            assert given.setdefault(plain(a), plain(b)) == plain(b) and used.setdefault(plain(b), plain(a)) == plain(a)
            assert plain(b) not in {plain(e) for e in pool}
            if "@" not in a and "." not in a:
                assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) and (len(plain(a)) != 16 or luhn(b))


#: Fixed parts of names: titles by gender, and what stands around words, whose places are held by 0 (given) and 1 (surname).
FORMS = ["{t} 1", "{t} 0 1", "{t} 0-0 1", "{t} 0 1-1", "{t} van der 1", "{t} 0 de la 1", "{t} O'1", "{t} Mc1", "{t} 0 De1", "{t} J. 1", "{t} J.R. 1", "{t} 0 K. 1", "{t} d’1", "{t} al-1"]
TITLED = {"o": ["Mr.", "Mr", "Herr Dr."], "a": ["Mrs.", "Ms", "Frau Prof. Dr."], "e": ["Dr.", "Prof. Dr. med."]}
SHOUTED = {"o": ["MR.", "MR"], "a": ["MRS.", "MS."], "e": ["DR.", "PROF."]}
#: Fixed forms of phone and account numbers; 0 holds a drawn digit, other digits stay as they are.
NUMBERED = ["+44 20 0000 0000", "+33 0 00 00 00 00", "+49 (30) 0000000", "+4915000000000", "020 0000 0000", "030 0000000", "0171/0000000", "01 00 00 00 00", "call 000-0000", "(017) 000-0000", "+1 (017) 000-0000", "555-000-0000", "DE00 0000 0000 0000 0000 00", "GB00WXYZ00000000000000"]


def named(rng, pool):
    """A mention with a pattern that its surrogate must match: groups of the words that change."""
    shout = rng.random() < 0.25
    end, titles = rng.choice(list((SHOUTED if shout else TITLED).items()))
    form, title = rng.choice(FORMS[:2] + FORMS[6:8] if shout else FORMS), rng.choice(titles)
    text, pattern, words = "", "", []
    for c in form.replace("{t}", title):
        if c in "01":
            word = rng.choice(pool)
            words.append((c, word))
            text += word.upper() if shout else word
            made = "[a-z]*" + (end if c == "0" else "son")
            pattern += f"([A-Z]{made.upper() if shout else made})"
        else:
            text += c
            pattern += re.escape(c)
    for letter in "JRK":
        pattern = re.sub(rf"(?<= ){letter}(?=\\\.)|(?<=\.){letter}(?=\\\.)", f"(?!{letter})[A-Z]", pattern)
    return text, pattern, words


def test_names_phones_and_accounts_match_brute_force(spark):
    """Mentions of known make: all are replaced in their format, alike everywhere, distinctly, and nothing else is."""
    import random

    rng = random.Random(11)
    pool = [a + b + c for a in ("Quex", "Wyx", "Hjaw") for b in ("ab", "ox", "uth") for c in ("quist", "wick", "hey")]
    account = lambda t: t[:2] in ("DE", "GB")
    plain = lambda t: t if account(t) else re.sub("[^0-9]", "", t)[-10:]
    mask = lambda t: t[:2] + re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t))[2:] if account(t) else re.sub("[0-9]", "0", t)
    rows, truth = [], []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                parts.append(("name", *named(rng, pool)))
            else:
                form = rng.choice(NUMBERED)
                start = 5 if form[0] in "0(" else 0
                made = form[:start] + re.sub("0", lambda m: rng.choice("123456789"), form[start:])
                parts.append(("number", made, None, None))
        rows.append((k, f"row {k} begins; " + " ; ".join(p[1] for p in parts) + " ; over and out"))
        truth.append(parts)
    given, used, numbers = {}, {}, {}
    for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        parts, after = truth[r.doc_id], r.text.split(" ; ")
        head, after = after[0].split("; ", 1)[0], [after[0].split("; ", 1)[1], *after[1:]]
        assert head == f"row {r.doc_id} begins" and after[-1] == "over and out" and len(after) == len(parts) + 1
        assert r.n_entities == len(parts), (rows[r.doc_id], r.text)
        for (sort, old, pattern, words), new in zip(parts, after):
            if sort == "name":
                met = re.fullmatch(pattern, new)
                assert met, (old, new)
                for (kind, a), b in zip(words, met.groups()):
                    stem = re.sub("(son|[oae])$", "", b.lower())
                    assert given.setdefault((kind, a), stem) == stem and used.setdefault((kind, stem), a) == a
                    assert a.lower() not in new.lower()
            else:
                assert mask(old) == mask(new) and plain(old) != plain(new)
                assert numbers.setdefault(plain(old), plain(new)) == plain(new)
    assert len(set(numbers.values())) == len(numbers) and len(given) > 40


def test_names_in_running_text(spark):
    texts = [
        (1, "Mr. Smith-Jones came, Smith-Jones left; Smith's hat"),
        (2, "Ms. van Dyke and Mr O'Brien's dog; O’Hara, Dr. J. Smith"),
        (3, "Prof. Dr. Meyer wrote; Meyer read. Mr. Smith CEO spoke. Dr. Drake"),
        (4, "I MISS YOU, MS OFFICE, Dr. and Prof. said 100-2000, 01-02-2024, 01/02/2024, 12:30, 1+1 and 3.14"),
    ]
    found = {r.doc_id: r for r in replace_entities(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    one = re.fullmatch(r"Mr\. (\w+)-(\w+) came, (\w+)-(\w+) left; (\w+)'s hat", found[1].text)
    assert one and one[1] == one[3] and one[2] == one[4] and one[1] != "Smith" and one[5] == one[1]
    assert re.fullmatch(r"Ms\. van (?!Dyke)\w+ and Mr O'(?!Brien)\w+'s dog; O’Hara, Dr\. (?!J)[A-Z]\. (?!Smith)\w+", found[2].text)
    three = re.fullmatch(r"Prof\. Dr\. (\w+) wrote; (\w+) read\. Mr\. (\w+) CEO spoke\. Dr\. (\w+)", found[3].text)
    assert three and three[1] == three[2] and not {"Meyer", "Smith", "Drake"} & set(three.groups())
    assert found[4].text == texts[3][1] and found[4].n_entities == 0


def test_edges(spark):
    left = replace_entities(edges(spark, "found"))
    assert left.columns == [*edges(spark, "found").columns, "n_entities"]
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(d), str(t)) for d, t, *_ in EDGES)
    assert replace_entities(empty(spark)).count() == 0
