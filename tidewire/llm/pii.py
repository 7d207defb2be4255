"""Surrogates for personal data, in DataFrame and SQL operations only.

Entities are found by pattern, and numbers with check digits by those too; each
is replaced by a stand-in worked out from a secret key, its kind and its
canonical form. The same entity so gets the same stand-in in every document
without a lookup, and only the few whose stand-ins collide are looked up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, columns_of, require, text_hash, unused

#: Titles and given names by gender; the stand-in of a name keeps title, gender, script and number of words.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Sir|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Lady|Госпожа"
ANY_TITLES = "Dr|Prof"
MALE_NAMES = (
    "Adam Alan Albert Alejandro Alexander Andrew Antonio Arthur Benjamin Bernard Brian Carlos Charles Christian Christopher Daniel David Diego Dieter "
    "Edward Eric Fernando Francis Frank Friedrich George Gerhard Hans Heinrich Henri Henry Hugo Jack Jacques James Javier Jean John Jorge José Juan "
    "Jürgen Karl Kevin Klaus Lars Louis Luc Luis Manuel Mark Martin Matthew Michael Michel Miguel Nicolas Oliver Pablo Patrick Paul Pedro Pete Peter "
    "Philip Pierre Ralf Ricardo Richard Robert Roger Samuel Sebastian Simon Stefan Stephen Steven Thomas Timothy Walter William Wolfgang"
).split()
FEMALE_NAMES = (
    "Alice Alicia Amanda Amélie Ana Andrea Angela Anna Anne Barbara Beatriz Birgit Brigitte Camille Carmen Caroline Catherine Chloé Christine Claire "
    "Claudia Cristina Diana Dolores Elena Elizabeth Emily Emma Eva Françoise Greta Hannah Heike Helen Helga Ingrid Isabel Isabelle Jane Jennifer Jessica "
    "Joan Juana Julia Julie Karen Katharina Laura Linda Lisa Lucía Margaret Maria María Marie Marta Mary Monika Nancy Nathalie Nicole Nina Olivia Patricia "
    "Petra Pilar Rachel Rebecca Renate Rosa Ruth Sabine Sandra Sara Sarah Silvia Sofía Sophie Susan Sylvie Teresa Ursula Valérie Victoria"
).split()
CYRILLIC_MALE = "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Юрий".split()
CYRILLIC_FEMALE = "Анна Валентина Вера Галина Екатерина Елена Ирина Любовь Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split()
LATIN_SYLLABLES = "bar den fol gar hol kin lan mor nel por ras sel tan vel wen zor".split()
CYRILLIC_SYLLABLES = "бар ден фол гар хол кин лан мор нел пор рас сел тан вел мин зор".split()

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{ANY_TITLES}"
_GIVEN = "|".join(MALE_NAMES + FEMALE_NAMES + CYRILLIC_MALE + CYRILLIC_FEMALE)
#: Words that make a place of a given name before them.
_PLACES = "Station|Street|Road|Avenue|Square|Park|Bridge|River|Lake|Island|Falls|University|College|Hospital|Airport|County|City|Beach|Hill|House"
_LABELS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
#: Kind, and its pattern. ``kind_of`` gives a match its kind.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\d)])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\p{L}\p{N}])\d{13,19}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[a-fA-F0-9]*\d\d)[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])"
    rf"|(?<=[=:\x22'\s])(?:(?=[^\s\x22'<>]*\d)|(?<=\b(?i:{_LABELS})=[\x22']?))(?<=\b(?i:{_LABELS})[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?)[^\s\x22'<>]{{8,}}",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) (?!(?:{_PLACES})\b){_NAME})",
}
PATTERN = "|".join(KINDS.values())
#: Every match but a name holds a digit or one of these, which are quick to look for.
_HINT = rf"[0-9@]|AKIA|(?:sk|ghp|xox[bp])[_-]|(?i:{_LABELS})="


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _digits(text: Column) -> Column:
    """array<int> of the digits of a string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike(r"^\d$")), lambda c: c.cast("int"))


def luhn_rest(digits: Column) -> Column:
    """The Luhn sum of the digits modulo 10; 0 for a valid number."""
    odd = F.size(digits) % 2

    def worth(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == odd, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x) % 10


def iban_rest(iban: Column) -> Column:
    """The number of an IBAN without spaces modulo 97; 1 for a valid one."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    value = F.transform(F.filter(turned, lambda c: c != ""), lambda c: F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def kind_of(match: Column) -> Column:
    """The kind of a match; null for a number whose check digits say that it is none."""
    valid_card = _let(_digits(match), luhn_rest) == 0
    return (
        F.when(match.contains("@") & match.rlike(rf"^{KINDS['email']}$"), "email")
        .when(match.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^\+[\d (]|^\(|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(match.rlike(r"^(\d{4}[ -]){3}\d{4}$|^\d{13,19}$"), F.when(valid_card, "card"))
        .when(match.rlike(r"^([0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|(sk|ghp|xox[bp])[_-].*)$"), "secret")
        .when(match.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$"), F.when(iban_rest(F.regexp_replace(match, " ", "")) == 1, "iban"))
        .when(match.rlike(r"^\p{Lu}[\p{L}'’. -]*$"), "name")
        .otherwise("secret")
    )


def bare_name(match: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(match, rf"^(?:{_TITLES})\.? ", "")


def gender_of(match: Column) -> Column:
    male, female = "|".join(MALE_NAMES + CYRILLIC_MALE), "|".join(FEMALE_NAMES + CYRILLIC_FEMALE)
    return F.when(match.rlike(rf"^(?:{MALE_TITLES})\b|(?:^| )(?:{male})(?: |$)"), F.lit("m")).when(match.rlike(rf"^(?:{FEMALE_TITLES})\b|(?:^| )(?:{female})(?: |$)"), F.lit("f")).otherwise(F.lit("n"))


def canonical(kind: Column, match: Column) -> Column:
    """What tells entities of a kind apart: digits alone for numbers, no case for addresses and hex secrets, a word for names."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(match, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when((kind == "secret") & ~match.rlike("^[0-9a-fA-F]+$"), match)
        .otherwise(F.lower(match))
    )


def units(entity: Column) -> Column:
    """array<struct<kind, canon, form>>: what gets a stand-in of its own; of a name each word, as family or given name.

    So "John Smith", "Mr. Smith" and "Smith" share a family name. A given name
    of the lists takes another of its list; other first words are ``given``.
    """
    one = F.array(F.struct(entity["kind"].alias("kind"), canonical(entity["kind"], entity["match"]).alias("canon"), entity["match"].alias("form")))

    def words(ws: Column) -> Column:
        def unit(w: Column, i: Column) -> Column:
            kind = F.when((i < F.size(ws) - 1) | F.array_contains(_listed(), w), "given").otherwise("family")
            return F.struct(kind.alias("kind"), F.lower(w).alias("canon"), w.alias("form"))

        return F.transform(ws, unit)

    return F.when(entity["kind"] == "name", _let(F.split(bare_name(entity["match"]), " "), words)).otherwise(one)


def _listed() -> Column:
    return F.array(*map(F.lit, MALE_NAMES + FEMALE_NAMES + CYRILLIC_MALE + CYRILLIC_FEMALE))


def _number(digest: Column, at: int, below: int) -> Column:
    """A number below ``below`` from fifteen hex digits of the digest."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % below


#: Syllables of a first stand-in, those that each further attempt adds, and the most; as many names as there are find room.
_FIRST, _MORE, _MOST = 4, 2, 16


def _syllables(digest: Column, words: list[str], attempt: Column) -> Column:
    pick = F.array(*[F.get(F.array(*map(F.lit, words)), (_number(digest, 1 + 7 * i, len(words))).cast("int")) for i in range(_MOST)])
    return F.initcap(F.array_join(F.slice(pick, F.lit(1), F.least(_FIRST + _MORE * attempt, F.lit(_MOST)).cast("int")), ""))


def _trades(names: list[str], key: str, label: str) -> list[str]:
    """Whom each name of a list becomes: the next in an order that the key sets, so that a known pair tells only of itself."""
    order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{label}|{n}".encode()).digest())
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    return [after[n] for n in names]


def _other_of_list(word: Column, key: str) -> Column:
    """A listed given name's stand-in: another of its list, such that no two meet."""
    out = F.lit(None).cast("string")
    for label, names in (("fm", FEMALE_NAMES), ("ma", MALE_NAMES), ("cf", CYRILLIC_FEMALE), ("cm", CYRILLIC_MALE)):
        list_, others = F.array(*map(F.lit, names)), F.array(*map(F.lit, _trades(names, key, label)))
        out = F.when(F.array_contains(list_, word), F.get(others, (F.array_position(list_, word) - 1).cast("int"))).otherwise(out)
    return out


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The stand-in of a unit: its shape, filled from a keyed digest of its canonical form.

    Digits stay digits, letters letters of the same case, marks stay; cards and
    IBANs keep valid check digits; an address moves to the reserved domain
    ``.example``, an IP to the reserved block above 240; a name keeps gender
    and script.
    """

    def from_digest(h: Column) -> Column:
        both = F.concat(h, F.sha2(h, 256))
        times = (F.length(form) / 100 + 1).cast("int")
        stream = F.repeat(both, times)
        digits = F.repeat(F.concat(*[F.lpad(_number(both, 1 + 15 * i, 10**14).cast("string"), 14, "0") for i in range(8)]), times)
        letters = F.translate(stream, "0123456789abcdef", "qrstuvwxyzabcdef")
        chars = F.split(form, "")

        def shaped(c: Column, i: Column) -> Column:
            return (
                F.when(c.rlike(r"^\d$"), F.substring(digits, i + 1, F.lit(1)))
                .when(c.rlike(r"^\p{Lu}$"), F.upper(F.substring(letters, i + 1, F.lit(1))))
                .when(c.rlike(r"^\p{L}$"), F.substring(letters, i + 1, F.lit(1)))
                .otherwise(c)
            )

        def filled(numbers: Column) -> Column:
            """The form with its digits taken from ``numbers`` in order."""

            def put(c: Column, i: Column) -> Column:
                ordinal = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), r"\D", ""))
                return F.when(c.rlike(r"^\d$"), F.substring(numbers, ordinal + 1, F.lit(1))).otherwise(c)

            return F.array_join(F.transform(chars, put), "")

        def checked(n: Column) -> Column:
            """``n`` digits of which the last is the check digit."""
            head = F.substring(digits, F.lit(1), n - 1)
            return F.concat(head, (F.pmod(F.lit(0) - _let(_digits(F.concat(head, F.lit("0"))), luhn_rest), F.lit(10))).cast("string"))

        def iban() -> Column:
            bare = F.regexp_replace(form, " ", "")
            body = F.array_join(F.transform(F.split(F.substring(bare, F.lit(5), F.length(bare)), ""), shaped), "")
            country = F.substring(bare, 1, 2)
            check = F.lpad((F.lit(98) - iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
            whole = F.concat(country, check, body)
            spaced = lambda c, i: F.when(c == " ", c).otherwise(F.substring(whole, F.length(F.regexp_replace(F.substring(form, F.lit(1), i), " ", "")) + 1, F.lit(1)))
            return F.array_join(F.transform(chars, spaced), "")

        hexed = F.transform(chars, lambda c, i: F.when(c.rlike("^[A-F]$") | ((c.rlike(r"^\d$")) & ~form.rlike("[a-f]") & form.rlike("[A-F]")), F.upper(F.substring(stream, i + 1, F.lit(1)))).otherwise(F.substring(stream, i + 1, F.lit(1))))
        octet = lambda at, base, span: (F.lit(base) + _number(h, at, span)).cast("string")
        cyrillic = form.rlike(r"\p{IsCyrillic}")
        word = F.when(cyrillic, _syllables(both, CYRILLIC_SYLLABLES, attempt)).otherwise(_syllables(both, LATIN_SYLLABLES, attempt))
        local = F.array_join(F.slice(F.transform(chars, shaped), F.lit(1), F.instr(form, "@") - 1), "")
        more = F.when(attempt > 0, F.substring(digits, F.lit(57), F.lit(6))).otherwise(F.lit(""))
        domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(F.regexp_extract(form, "@(.*)$", 1))), 256)
        return (
            F.when(kind == "email", F.concat(local, more, F.lit("@"), F.translate(F.substring(domain, 1, 8), "0123456789", "ghijklmnop"), F.lit(".example")))
            .when(kind == "ip", F.concat_ws(".", octet(1, 240, 16), octet(9, 0, 256), octet(17, 0, 256), octet(25, 0, 256)))
            .when(kind.isin("phone", "ssn"), filled(digits))
            .when(kind == "card", filled(checked(F.length(F.regexp_replace(form, r"\D", "")))))
            .when(kind == "iban", iban())
            .when((kind == "secret") & form.rlike("^[0-9a-fA-F]+$"), F.array_join(hexed, ""))
            .when(kind == "given", F.coalesce(_other_of_list(form, key), word))
            .when(kind == "family", word)
            .otherwise(F.array_join(F.transform(chars, shaped), ""))
        )

    return _let(F.sha2(F.concat_ws("|", F.lit(key), kind, canonical(kind, form), attempt.cast("string")), 256), from_digest)


def pattern_of(text: Column) -> Column:
    """The pattern for a text: where it names people, their names alone count too, as family or given name."""

    def own(names: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(bare_name(n), " "))))
        return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(PATTERN))

    return _let(F.regexp_extract_all(text, F.lit(KINDS["name"]), F.lit(0)), own)


def entities(text: Column) -> Column:
    """struct<found array<struct<kind, match>>, between array<string>>: the entities in text order and what lies around them.

    Matches that turn out to be no entities have a null kind. Nothing is looked
    for in texts without a hint of any.
    """
    named = text.rlike(KINDS["name"])
    typed = lambda found: F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    cut = lambda p: F.struct(typed(F.regexp_extract_all(text, p, F.lit(0))).alias("found"), F.split(text, p).alias("between"))
    nothing = F.struct(F.array().cast("array<struct<kind:string,match:string>>").alias("found"), F.array(F.coalesce(text, F.lit(""))).alias("between"))
    return F.when(named, _let(pattern_of(text), cut)).when(text.rlike(_HINT), cut(F.lit(PATTERN))).otherwise(nothing)


def _units_of(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """(kind, canon, form) of all entities of the documents."""
    each = docs.select(*keep, F.explode(entities(F.col(text_col))["found"]).alias("e")).filter("e.kind IS NOT NULL")
    names = [c for c in each.columns if c != "e"]
    return each.select(*names, F.explode(units(F.col("e"))).alias("u")).select(*names, "u.kind", "u.canon", "u.form")


def _attempts(docs: DataFrame, text_col: str, key: str, shelf: Shelf) -> DataFrame | None:
    """(kind, canon, attempt) of the units whose first stand-in collides; None if there are none.

    A stand-in collides if another unit has it, then the least canonical form
    keeps it, or if it is itself a unit of the documents. Given names of the
    lists only trade places, and don't collide. Each attempt makes a name longer,
    so that the names that are left soon find room.
    """
    each = _units_of(docs, text_col).filter(~((F.col("kind") == "given") & F.array_contains(_listed(), F.col("form"))))
    state = shelf.put(each.groupBy("kind", "canon").agg(F.min("form").alias("form")).withColumn("attempt", F.lit(0)), "entities")
    # A stand-in takes a fraction of a millisecond, so a thousand or so make a task, however many there are.
    tasks = max(1, state.count() // 1000)
    known = state.select("kind", F.col("canon").alias("stand_in"))
    while True:
        drawn = state.repartition(tasks, "kind", "canon").withColumn("stand_in", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)))
        drawn = shelf.put(drawn.select("kind", "canon", "attempt", "stand_in"), "drawn")
        owners = drawn.groupBy("kind", "stand_in").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("c")).filter("c > 1")
        again = drawn.join(owners, ["kind", "stand_in"]).filter(F.struct("attempt", "canon") != F.col("owner")).select("kind", "canon")
        again = again.union(drawn.join(known, ["kind", "stand_in"], "left_semi").select("kind", "canon")).distinct().withColumn("again", F.lit(1))
        again = shelf.put(again, "again")
        if again.isEmpty():
            break
        state = shelf.put(state.join(again, ["kind", "canon"], "left").select("kind", "canon", "form", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "entities")
    late = state.filter("attempt > 0").select("kind", "canon", "attempt")
    return None if late.isEmpty() else late


def replace_entities(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every detected entity replaced by its stand-in.

    Adds n_entities and surrogates (array<struct<kind, surrogate>> in text
    order); other columns pass through, but old ones of those names. Within a
    kind, different entities get different stand-ins, none of which occurs in
    the documents as an entity; one entity gets the same one everywhere, also
    in another format or case. Of people, who are found by a title or a listed
    given name before a name, the same text's lone family and given names
    follow. Numbers of 13 to 19 digits are cards only with a valid Luhn digit,
    IBANs only with a valid check. ``key`` must be given and not empty.

    A null text becomes empty; ids may be null or repeat; very long texts take
    time in proportion; an empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    if not key:
        raise ValueError("surrogates need a key")
    shelf = Shelf(docs.sparkSession, "pii")
    late = _attempts(docs, text_col, key, shelf)
    cut, new, attempts, no_id, row, mark = unused(docs, "cut", "new", "attempts", "no_id", "row", "mark")
    if late is None:
        marked = docs.withColumn(attempts, F.lit(None).cast("map<string,int>"))
    else:
        keyed = docs.withColumns({no_id: F.col(id_col).isNull(), row: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), mark: text_hash(F.col(text_col))})
        own = _units_of(keyed, text_col, F.col(no_id), F.col(row), F.col(mark)).drop("form").distinct().join(late, ["kind", "canon"])
        own = own.groupBy(no_id, row, mark).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias(attempts))
        marked = keyed.join(own, [no_id, row, mark], "left")
    titles = rf"^(?:(?:{_TITLES})\.? )?"

    def stand_in(e: Column) -> Column:
        def one(u: Column) -> Column:
            attempt = F.coalesce(F.element_at(F.col(attempts), F.concat_ws("|", u["kind"], u["canon"])), F.lit(0))
            return surrogate(u["kind"], u["form"], attempt, key)

        whole = F.array_join(F.transform(units(e), one), " ")
        whole = F.when(e["kind"] == "name", F.concat(F.regexp_extract(e["match"], titles, 0), whole)).otherwise(whole)
        return F.struct(e["kind"].alias("kind"), F.when(e["kind"].isNull(), e["match"]).otherwise(whole).alias("surrogate"))

    marked = marked.withColumn(cut, entities(F.col(text_col))).withColumn(new, F.transform(F.col(f"{cut}.found"), stand_in))
    pieces = F.zip_with(F.col(f"{cut}.between"), F.col(f"{new}.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    real = F.filter(F.col(new), lambda s: s["kind"].isNotNull())
    text = F.when(F.size(real) > 0, F.concat_ws("", pieces)).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    return marked.select(*columns_of(docs, text_col, "n_entities", "surrogates"), text.alias(text_col), F.size(real).alias("n_entities"), real.alias("surrogates"))
