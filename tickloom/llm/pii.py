"""Surrogates for personal data: keyed, type-consistent replacements.

Entities are found by one regular expression, and named by what identifies them whatever the surface (a mailbox and its
domain in lower case, the digits of a phone or card number, each part of a person's name, whatever its title, place or
capitals). Names are found by their titles, and in a text that names somebody so, wherever else a part of that name stands
alone. Every distinct entity of the corpus gets one surrogate, made from a keyed hash: of the same type and format, of the
same length for addresses, numbers and secrets, with a valid check digit for cards, and for names of the same script, and of
the gender that the name's titles say (neither, if they disagree). Surrogates that meet (each other, or an entity that
really occurs) are drawn again until all are distinct; so two texts name the same entity after the replacement exactly if
they did before. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

_NAME = r"\p{Lu}[\p{L}'’-]++"
#: Titles by gender (m, f, n: neither); fixed values.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "господин", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Signora", "госпожа", "Госпожа"),
    "n": ("Dr", "Prof", "Professor", "Doktor", "Docteur"),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_WORDS = r"(?:password|passwd|pwd|secret|token|api_key|apikey)"
#: What leads to a secret; it is part of the match and stays.
_LEAD = rf"{_WORDS}\s{{0,3}}[=:]\s{{0,3}}[\"']?"
#: The types in order of precedence, each a regular expression without capturing groups. Each begins with what few places
#: in prose have, as all are tried at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?=[pstaPSTA])(?<!\w)(?i:{_LEAD})[A-Za-z0-9_+/-]{{8,}}+",
    "key": r"(?=[Ags])(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}+\b|sk-[A-Za-z0-9]{20,}+\b)",
    # eight groups, three or more with a gap, or two after a prefix of public, local or link-local addresses
    "ipv6": rf"(?=[0-9A-Fa-f:]{{2}})(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,6}}|{_HEX}:(?::{_HEX}){{2,6}}|::(?:{_HEX}:){{2,6}}{_HEX}|(?:[23][0-9A-Fa-f]{{3}}|[Ff][CcDd][0-9A-Fa-f]{{2}}|[Ff][Ee]80)::{_HEX})(?![\w:])",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # a whole run of groups of digits, less those before a decimal point; card_runs finds the cards in it
    "card": r"(?=\d)(?<![\d.+-])(?=\d(?!\d*+\.\d)(?:[ -]?+\d(?!\d*+\.\d)){12})\d++(?:[ -]\d++(?!\.\d))*+",
    "phone": r"(?=[+\d(])(?:(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))",
    # not after an article, where it is a book's or a place's name
    "person": rf"(?<![Tt]he )(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?<!\p{{L}})(?:" + "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True)) + rf")\.?[ ]{_NAME}(?:[ ]{_NAME})*+",
}
#: A capitalised word by itself: where a text names a person with a title, these may name the person again.
WORD = r"(?<![\p{L}\p{N}@._-])\p{Lu}[\p{L}'’]*+(?:-\p{Lu}[\p{L}'’]*+)*+(?![\p{L}\p{N}@_])"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ANY_OR_WORD = f"{ANY}|(?:{WORD})"
#: Syllables, and endings of given names by gender and of surnames, for each script that has capitals; other such scripts take
#: the Latin ones.
SYLLABLES = {
    "Latin": ("ba", "be", "da", "de", "do", "fa", "ga", "ha", "ka", "la", "le", "li", "ma", "mi", "na", "ne", "ra", "ri", "sa", "ta", "te", "to", "va", "vi"),
    "Cyrillic": ("ба", "бо", "ва", "ви", "га", "да", "до", "за", "ка", "ко", "ла", "ли", "ма", "ми", "на", "ни", "па", "ра", "ро", "са", "та", "ти", "ха", "ше"),
    "Greek": ("βα", "βε", "γα", "δα", "δε", "ζα", "θα", "κα", "κο", "λα", "λε", "λι", "μα", "μι", "να", "νε", "πα", "ρα", "ρι", "σα", "τα", "τε", "φα", "χα"),
    "Armenian": ("բա", "գա", "դա", "զա", "թա", "լա", "լի", "կա", "հա", "մա", "մի", "նա", "նի", "շա", "պա", "ռա", "սա", "վա", "տա", "րա", "փա", "քա", "ֆա", "ջա"),
}
ENDINGS = {
    "Latin": {"m": ("n", "r", "s", "rd"), "f": ("na", "lia", "ra", "sa"), "n": ("ni", "le", "ry", "mi"), "s": ("son", "man", "ler", "rez")},
    "Cyrillic": {"m": ("н", "р", "с", "м"), "f": ("на", "лия", "ра", "са"), "n": ("ни", "ле", "ми", "ри"), "s": ("енко", "ко", "дзе", "ук")},
    "Greek": {"m": ("ος", "ης", "ων", "ας"), "f": ("νη", "λια", "ρα", "σα"), "n": ("νι", "λε", "μι", "ρι"), "s": ("πουλος", "ακης", "ιδης", "ου")},
    "Armenian": {"m": ("ն", "ր", "ս", "մ"), "f": ("նե", "լիա", "րա", "սա"), "n": ("նի", "լե", "մի", "րի"), "s": ("յան", "ունի", "ենց", "ցի")},
}
#: Draws after which surrogates of a free form grow by a character, so that there are always new ones.
DRAWS = 8
#: How many different surrogates there are of the kinds that have a fixed form; all others grow.
SPACES = {"ip": 1 << 28, "ssn": 10**8, "card": 10**11}


def kind_of(match: Column) -> Column:
    """The type of an entity: the first whose pattern the whole of it matches."""
    found = F.when(match.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind, p in list(PATTERNS.items())[1:]:
        found = found.when(match.rlike(f"^(?:{p})$"), kind)
    return found.otherwise("word")


def draw(base: Column, i: Column) -> Column:
    """The i-th number of the stream that a keyed base gives."""
    return F.conv(F.substring(F.sha2(F.concat(base, F.lit("|"), i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")


def same_shape(text: Column, base: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """The text with each digit, small and capital letter drawn anew, all else as it is."""
    at = lambda s, r: F.substring(F.lit(s), (r % len(s) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        r = draw(base, i)
        return F.when(c.rlike("[0-9]"), (r % 10).cast("string")).when(c.rlike("[a-z]"), at(letters, r)).when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last place is a check digit."""
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((F.length(digits) - i) % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d(i) + 1)).otherwise(d(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))


def card_runs(run: Column) -> Column:
    """A run of groups of digits with its cards in braces, and its other entities in angle brackets.

    A card is a stretch of whole groups that has 13 to 19 digits and passes the check; from the left, and the longest from
    a group on. A stretch does not reach into a social security or phone number."""
    pattern = r"<[^>]*+>|[ -]|\d++"
    tokens = F.regexp_extract_all(F.regexp_replace(run, f"(?:{PATTERNS['ssn']})|(?:{PATTERNS['phone']})", "<$0>"), F.lit(pattern), F.lit(0))
    joined = lambda xs, i, n: F.array_join(F.slice(xs, i + 1, n), "")
    digits = lambda x: F.translate(x, " -", "")
    fits = lambda x: F.when(x.rlike(r"^\d[\d -]*+(?<=\d)$") & F.length(digits(x)).between(13, 19), luhn_sum(digits(x)) % 10 == 0).otherwise(False)

    def step(a: Column, i: Column) -> Column:
        # 19 groups of a digit and the 18 places between them
        best = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(37), F.size(tokens) - i)), lambda n: fits(joined(tokens, i, n))))
        card = F.struct((i + best).alias("next"), F.concat(a["text"], F.lit("{"), joined(tokens, i, best), F.lit("}")).alias("text"))
        other = F.struct((i + 1).alias("next"), F.concat(a["text"], F.get(tokens, i)).alias("text"))
        return F.when(i < a["next"], a).when(best.isNotNull(), card).otherwise(other)

    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda a: a["text"])


def surrogate(key: str, kind: Column, name: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of an entity of this kind and name, at this attempt; gender is a name part's (s: a surname)."""
    base = F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string"))
    number = same_shape(name, base)
    grown = same_shape(F.repeat(F.lit("a"), F.floor(attempt / DRAWS).cast("int")), F.concat(base, F.lit("+")))
    # a mailbox's surrogate is told apart within its domain, which gets a surrogate of its own
    local = F.concat(same_shape(F.substring_index(name, "@", 1), base), grown, F.lit("@"), F.substring_index(name, "@", -1))
    top = F.substring_index(name, ".", -1)
    domain = F.concat(same_shape(F.substring(name, F.lit(1), F.length(name) - F.length(top) - 1), base), grown, F.lit("."), top)
    first = F.when(F.substring(name, 1, 1) == "0", "0").otherwise((draw(base, F.lit(0)) % 9 + 1).cast("string"))
    body = F.concat(F.substring(name, 1, 1), F.substring(number, F.lit(2), F.length(name) - 2))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    phone = F.concat(F.substring(name, F.lit(1), F.length(name) - 9), (draw(base, F.lit(1)) % 8 + 2).cast("string"), F.substring(number, F.length(name) - 7, F.lit(8)))
    longer = same_shape(F.repeat(F.lit("0"), F.floor(attempt / DRAWS).cast("int")), F.concat(base, F.lit("+")))
    # ranges that are reserved, so nobody's: 2001:db8::/32, in full length whatever the address was, and 240.0.0.0 to 255.255.255.255
    ip = F.concat((240 + draw(base, F.lit(9)) % 16).cast("string"), F.lit("."), F.array_join(F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: (draw(base, i) % 256).cast("string")), "."))
    ipv6 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.array(*[F.lit(i) for i in range(6)]), lambda i: F.lower(F.hex(draw(base, i) % 65536))), ":"))
    hexes = F.when(name.rlike("^[0-9a-f]+$"), same_shape(name, base, "abcdef")).otherwise(number)
    result = F.when(kind == "local", local).when(kind == "domain", domain).when(kind == "card", F.concat(body, check.cast("string"))).when(kind == "phone", F.concat(F.when(F.length(name) >= 10, phone).otherwise(F.concat(first, F.substring(number, F.lit(2), F.length(name)))), longer))
    result = result.when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "key", F.concat(F.substring(name, 1, 4), F.substring(number, F.lit(5), F.length(name)), grown))
    result = result.when(kind == "secret", F.concat(hexes, grown)).when(kind == "ssn", F.concat(F.lit("9"), F.substring(number, 2, 10)))
    return result.otherwise(person(kind, gender, base, attempt))


def person(kind: Column, gender: Column, base: Column, attempt: Column) -> Column:
    """A name part of the script that the kind tells (name:Latin)."""
    pick = lambda xs, r: F.element_at(F.array(*map(F.lit, xs)), (r % len(xs) + 1).cast("int"))
    spell = lambda xs: lambda i: pick(xs, draw(base, i))
    count = F.lit(2) + F.floor(attempt / 4).cast("int")
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        stem = F.array_join(F.transform(F.sequence(F.lit(1), count), spell(syllables)), "")
        end = F.lit(None).cast("string")
        for g, ends in ENDINGS[script].items():
            end = F.when(gender == g, pick(ends, draw(base, F.lit(0)))).otherwise(end)
        out = F.when(kind == f"name:{script}", F.initcap(F.concat(stem, end))).otherwise(out)
    return out


def dressed(surface: Column, kind: Column, value: Column) -> Column:
    """A surrogate in the format of the surface: punctuation of numbers and capitals of addresses and names as they stand."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    chars = F.filter(F.split(surface, ""), lambda c: c != "")
    upto = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9]", ""))
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(value, upto(i), F.lit(1))).otherwise(c)), "")
    bare = F.when(kind == "local", F.substring_index(value, "@", 1)).otherwise(value)
    address = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(bare, i + 1, F.lit(1)))).otherwise(F.substring(bare, i + 1, F.lit(1)))), "")
    capitals = kind.startswith("name:") & (F.length(surface) > 1) & (F.upper(surface) == surface)
    out = F.when(kind.isin("card", "phone") & (F.length(digits) == F.length(value)), number)
    return out.when(kind.isin("local", "domain") & (F.length(surface) == F.length(bare)), address).when(capitals, F.upper(value)).otherwise(bare)


def name_parts(match: Column) -> Column:
    """The parts of a person's name after the title."""
    return F.split(F.regexp_replace(match, r"^\S+[ ]", ""), " ")


def bare_name(part: Column) -> Column:
    """A part of a name without a possessive's end."""
    return F.regexp_replace(part, r"(?<=\p{L})['’]s?$", "")


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, tag, wide, pos, part, kind, name, gender, lead, surface, tail: a row for each part of each entity, in the order
    of the text.

    tag is a hash of the text, wide whether single words are matches in it too, lead and tail what stands around the part
    within the entity (a title, a blank, a possessive's end), gender a name part's (m, f, n; s for a surname; null for a word
    that names somebody again)."""
    text = F.coalesce("text", F.lit(""))
    titled = f"^(?:{PATTERNS['person']})$"
    known = lambda found: F.array_distinct(F.flatten(F.transform(F.filter(found, lambda m: m.rlike(titled)), lambda m: F.transform(name_parts(m), lambda p: F.lower(bare_name(p))))))
    # an array of one element binds what is used more than once, so that no text is searched again
    first = F.transform(F.array(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), lambda f: F.struct(f.alias("found"), known(f).alias("known")))
    # parts of names that the text also has as words: at a sentence's start, these are words
    common = lambda known: F.filter(known, lambda p: F.regexp_like(text, F.concat(F.lit(r"(?<!\p{L})"), p, F.lit(r"(?!\p{L})"))))
    second = F.transform(first, lambda x: F.struct(x["known"].alias("known"), common(x["known"]).alias("common"), F.when(F.size(x["known"]) > 0, F.regexp_extract_all(text, F.lit(ANY_OR_WORD), F.lit(0))).otherwise(x["found"]).alias("found")))
    before = F.when(F.size("x.common") > 0, F.split("text", ANY_OR_WORD, -1)).alias("before")
    df = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tag"), second[0].alias("x"))
    df = durable(df.select("doc_id", "tag", "x.*", before))
    df = df.where(F.size("found") > 0).withColumn("wide", F.size("known") > 0).distinct()
    df = df.select("doc_id", "tag", "wide", "known", "common", "before", F.posexplode("found").alias("pos", "match")).withColumn("type", kind_of(F.col("match")))
    part = F.lower(bare_name(F.col("match")))
    begins = F.get("before", F.col("pos")).rlike(r"[.!?:…][\s\"'“”»)]*$|[\n\r]\s*$") | ((F.col("pos") == 0) & F.get("before", F.lit(0)).rlike(r"^\s*$"))
    df = df.where((F.col("type") != "word") | (F.array_contains("known", part) & ~F.coalesce(F.array_contains("common", part) & begins, F.lit(False))))
    number = F.regexp_replace("match", "[^0-9]", "")
    df = df.withColumn("runs", F.when(F.col("type") == "card", card_runs(F.col("match"))))
    title = F.regexp_extract("match", r"^(\S+)[ ]", 1)
    bare = F.regexp_replace(title, r"\.", "")
    gender = F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f").otherwise("n")
    parts = F.when(F.col("type") == "word", F.array("match")).otherwise(name_parts(F.col("match")))
    script = lambda p: F.when(p.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(p.rlike(r"\p{IsGreek}"), "Greek").when(p.rlike(r"\p{IsArmenian}"), "Armenian").otherwise("Latin")
    entity = lambda kind, name, lead, surface, gender=F.lit(None).cast("string"), tail=F.lit(""): F.struct(kind.alias("kind"), name.alias("name"), gender.alias("gender"), lead.alias("lead"), surface.alias("surface"), tail.alias("tail"))
    role = lambda i: F.when(F.col("type") == "word", F.lit(None).cast("string")).when(i < F.size(parts) - 1, gender).otherwise("s")
    ahead = lambda i: F.when(F.col("type") == "word", "").when(i == 0, F.concat(title, F.lit(" "))).otherwise(" ")
    named = F.transform(parts, lambda p, i: entity(F.concat(F.lit("name:"), script(p)), F.lower(bare_name(p)), ahead(i), bare_name(p), role(i), F.substring(p, F.length(bare_name(p)) + 1, F.length(p))))
    before = F.when(F.col("type") == "secret", F.regexp_extract("match", f"^(?i:{_LEAD})", 0)).otherwise("")
    bare_secret = F.substring("match", F.length(before) + 1, F.length("match"))
    name = F.when(F.col("type") == "secret", bare_secret).when(F.col("type").isin("card", "phone"), number).when(F.col("type") == "ipv6", F.lower("match")).otherwise(F.col("match"))
    single = F.array(entity(F.col("type"), name, before, F.when(F.col("type") == "secret", bare_secret).otherwise(F.col("match"))))
    mailbox, domain = F.substring_index("match", "@", 1), F.substring_index("match", "@", -1)
    mail = F.array(entity(F.lit("local"), F.lower("match"), F.lit(""), mailbox), entity(F.lit("domain"), F.lower(domain), F.lit("@"), domain))
    # numbers in a run that fail the check are no cards and stay
    marked = r"<[^>]*+>|\{[^}]*+\}"
    gaps, marks = F.split("runs", marked, -1), F.regexp_extract_all("runs", F.lit(marked), F.lit(0))
    inner = lambda m: F.substring(m, F.lit(2), F.length(m) - 2)
    kind = lambda m: F.when(m.startswith("{"), "card").otherwise(F.when(inner(m).rlike(f"^(?:{PATTERNS['ssn']})$"), "ssn").otherwise("phone"))
    runs = F.transform(marks, lambda m, i: entity(kind(m), F.when(kind(m) == "ssn", inner(m)).otherwise(F.regexp_replace(m, "[^0-9]", "")), F.get(gaps, i), inner(m)))
    last = F.element_at(gaps, -1)
    left = F.filter(F.array(entity(F.lit("other"), last, F.lit(""), last)), lambda x: x["name"] != "")
    parts_of = F.when(F.col("type").isin("person", "word"), named).when(F.col("type") == "card", F.concat(runs, left)).when(F.col("type") == "email", mail).otherwise(single)
    return df.select("doc_id", "tag", "wide", "pos", F.posexplode(parts_of).alias("part", "x")).select("doc_id", "tag", "wide", "pos", "part", "x.*")


def assigned(found: DataFrame, key: str) -> DataFrame:
    """kind, name, value: one surrogate for each distinct entity, no two of a kind the same, and none that occurs itself.

    Draws go on until all are distinct, which free forms always become, as they grow; a kind of fixed form that has more
    than half as many entities as there are such forms is an error."""
    is_ = lambda g: F.max(F.coalesce(F.col("gender") == g, F.lit(False)))
    gender = F.when(is_("m") & is_("f"), "n").when(is_("f"), "f").when(is_("m"), "m").when(is_("n"), "n").otherwise("s")
    names = durable(found.where("kind <> 'other'").groupBy("kind", "name").agg(gender.alias("gender")).withColumn("attempt", F.lit(0)))
    for kind, n in names.where(F.col("kind").isin(*SPACES)).groupBy("kind").count().collect():
        if 2 * n > SPACES[kind]:
            raise ValueError(f"{n} entities of kind {kind} can't have distinct surrogates of their form")
    drawn = durable(names.withColumn("value", surrogate(key, F.col("kind"), F.col("name"), F.col("gender"), F.col("attempt"))))
    real = names.select(F.col("kind").alias("k"), F.col("name").alias("n")).withColumn("real", F.lit(True))
    while True:
        first = drawn.groupBy("kind", F.lower("value").alias("low")).agg(F.min(F.struct("attempt", "name")).alias("first"), F.count(F.lit(1)).alias("many"))
        first = first.join(real, (F.col("kind") == F.col("k")) & (F.col("low") == F.lower("n")), "left").where("many > 1 or real").select(F.col("kind").alias("k"), "low", "first", "real").distinct()
        first = durable(first)
        if first.isEmpty():
            return drawn.select("kind", "name", "value")
        clash = drawn.join(first, (F.col("kind") == F.col("k")) & (F.lower("value") == F.col("low")), "left")
        again = F.coalesce(F.col("real") | (F.struct("attempt", "name") != F.col("first")), F.lit(False))
        drawn = clash.withColumn("attempt", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")))
        drawn = durable(drawn.withColumn("value", F.when(again, surrogate(key, F.col("kind"), F.col("name"), F.col("gender"), F.col("attempt"))).otherwise(F.col("value"))).select("kind", "name", "gender", "attempt", "value"))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten, and _entities, the number of entities replaced in it (with further underscores if docs has
    such a column, which stays).

    A null text stays null. Rows that share id and text are rewritten alike. The same key gives the same surrogates on the
    same corpus. A text of any length is one row. Other columns are carried along; an empty table gives an empty result.
    Texts are read twice; only the entities, and then the texts once by document, are shuffled."""
    if not key:
        raise ValueError("surrogates need a key")
    found = durable(mentions(docs))
    values = assigned(found, key)
    rows = found.join(values, ["kind", "name"], "left")
    rows = rows.withColumn("text", F.concat("lead", F.coalesce(dressed(F.col("surface"), F.col("kind"), F.col("value")), F.col("surface")), "tail"))
    one = F.col("kind").contains(":") | F.col("kind").isin("local", "domain")
    count = F.count_distinct(F.when(F.col("kind") != "other", F.struct("pos", F.when(one, 0).otherwise(F.col("part")))))
    put = rows.groupBy("doc_id", "tag", "wide").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "text"))).alias("put"), count.alias("n"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias("\x1f")).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    df = packed.join(put, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tag")), "left").select("row", "wide", "put", "n")
    text = F.col("row.text")
    around = F.when(F.col("put").isNotNull(), F.when(F.col("wide"), F.split(text, ANY_OR_WORD, -1)).otherwise(F.split(text, ANY, -1)))
    # matches that stay as they are come with single words only
    match = F.when(F.col("wide"), F.regexp_extract_all(text, F.lit(ANY_OR_WORD), F.lit(0)))
    df = df.select("row", "put", "n", around.alias("around"), match.alias("match"))
    pieces = lambda i: F.filter("put", lambda p: p["pos"] == i)
    new = lambda i: F.when(F.size(pieces(i)) > 0, F.array_join(F.transform(pieces(i), lambda p: p["text"]), "")).otherwise(F.coalesce(F.get("match", i), F.lit("")))
    text = F.when(F.col("put").isNull(), text).otherwise(F.array_join(F.transform("around", lambda s, i: F.concat(s, new(i))), ""))
    kept = [text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    df = df.select(F.struct(*kept, F.coalesce("n", F.lit(0)).cast("long").alias(fresh(docs.columns, "_entities")[0])).alias("x"))
    return df.select("x.*")
