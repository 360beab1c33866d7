"""Operator 5, personal data: surrogate generation, in DataFrame functions only.

Detected: e-mail addresses, secrets (long hexadecimal tokens, and keys with a well-known beginning), card numbers with a
right Luhn digit, phone numbers, IPv4 addresses, social security numbers, and person names that follow a title.
Each entity is replaced in place by a keyed surrogate of its type and format:

* letters stand for letters of the same case, digits for digits, hexadecimal for hexadecimal,
  octets for octets; separators, a phone's country code, a key's beginning and a domain's last label stay; a card
  number keeps its Luhn digit right.  The replacement is a keyed bijection on strings of one
  format (each symbol is shifted by a keyed digest of the symbols before it, first forwards,
  then backwards), so entities of one format cannot share a surrogate;
* a name's parts get names made of syllables, in the part's script (Latin, Cyrillic, Greek) and,
  for given names, with an ending of the title's gender.  In a text with such a name its parts are
  replaced wherever they stand as capitalised words, with a title or without.

Equal entities (case aside, for addresses and names) get equal surrogates in all documents: that is
coreference.  The same holds within: a domain, a family name has one surrogate wherever it occurs.

Collision checks: the distinct entities of the whole corpus are gathered (a partial aggregate, so
hot entities do not pile up); an entity whose surrogate equals another's, or equals any real
entity, is keyed anew until none is left.  Those few keyed anew reach the texts as a map: inside the
expression up to ``literal_limit`` of them, by a join on the text's digest beyond.  Results are the same.

The key is a parameter; the query takes it from the setting ``spark.tidemark.surrogates.key``, and without one a key is
drawn for the application, so surrogates of different runs can't be linked.

Null text stays null, empty stays empty, texts without entities come back unchanged.  Rows may repeat;
an empty table gives an empty result.  Other columns are carried, whatever their names: the count of entities, ``n_entities``,
gets a trailing underscore, or more, where an input column has that name.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,254}+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
# How keys of well-known services begin.
KEY_STARTS = r"sk-(?:proj-|live-|test-)?|gh[oprsu]_|xox[abprs]-|AKIA"
SECRET = (
    rf"(?<![0-9A-Za-z])(?:(?=[0-9]*+[a-f])[0-9a-f]{{32,}}+|(?=[0-9]*+[A-F])[0-9A-F]{{32,}}+|(?:{KEY_STARTS})[0-9A-Za-z_]{{16,}}+)(?![0-9A-Za-z])"
)
#: A run of digits, then the usual groups, then any; what follows a card after a space is not taken for a part of it.
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9])|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![0-9])|[0-9]{2}(?:[ \-][0-9]{2}){7}(?![0-9])"
    r"|[0-9](?:[ \-]?[0-9]){12,18}(?!\.?[0-9]))"
)
PHONE = (
    r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{2,4}[ .\-]?[0-9]{3,5}(?![0-9])"
    r"|\+[0-9](?:[ .\-()/]{0,2}[0-9]){7,14}(?![0-9])"
    r"|(?<![0-9])(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.,/\-])0[0-9]{2,4}[ /\-][0-9]{5,8}(?![0-9])"
)
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
MALE = r"Mr|Sir|Herr|Monsieur|Señor|Sr|Г-н|Господин|Κύριος"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа|Κυρία"
EITHER = r"Dr|Prof"
#: The lookahead names the letters that titles begin with, so most places in a text are passed at once.
TITLE = rf"(?=[DFHMPSГΚ])(?:{FEMALE}|{MALE}|{EITHER})\.?[ \u00a0]"
INITIALS = r"(?:\p{Lu}\.[ \u00a0]?)*"
PART = r"\p{Lu}(?:\p{L}+(?:['’\-]\p{L}{2,})*|['’]\p{Lu}\p{L}+)"
NAME = rf"(?<!\p{{L}}){TITLE}{INITIALS}{PART}(?:[ \u00a0]{PART}){{0,3}}"
#: A capitalised word: in a text with a name, perhaps a part of it.
WORD = rf"(?<!\p{{L}}){PART}"
#: In this order; at one place the first that matches wins.
ENTITY = rf"{EMAIL}|{SECRET}|(?=[0-9(+])(?:{SSN}|{IP}|{PHONE}|{CARD})|{NAME}"
ENTITY_OR_WORD = rf"{ENTITY}|{WORD}"
#: A text without any of these has no entity.
HINT = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[ \-]?[0-9]){{12}}|[0-9A-Fa-f]{{32}}|(?=[gsxA])(?:{KEY_STARTS})|{TITLE}\p{{Lu}}"

# Syllables of made-up names, by script, and the endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo bra bre da de do dra fa fe fi ga ge go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we za ze".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де ди до жа за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то фа фе ха ша".split(),
    "greek": "βα βε βι βο γα γε γο δα δε δι δο ζα ζε θα θε θι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι τα τε τι το φα χα".split(),
}
ENDINGS = {
    "latin": {"female": "na", "male": "rn", "either": "ley", "family": "son"},
    "cyrillic": {"female": "на", "male": "слав", "either": "ль", "family": "енко"},
    "greek": {"female": "να", "male": "ρος", "either": "λη", "family": "ίδης"},
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once and named in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let2(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: body(v["a"], v["b"]))


def _number(key: str, *parts: Column) -> Column:
    """A keyed number of 40 bits: two nested digests, as in HMAC."""
    inner = F.sha2(F.concat(F.lit(f"{key}|in|"), *parts), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|out|"), inner), 256), 1, 10), 16, 10).cast("long")


def _char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _shifted(c: Column, by: Column, alphabet: str | None) -> Column:
    """``c`` moved within its alphabet; other characters stay."""

    def within(letters: str) -> Column:
        at = F.instr(F.lit(letters), c)
        return _char(F.lit(letters), (F.pmod(at - 1 + by, F.lit(len(letters))) + 1).cast("int"))

    if alphabet:
        return F.when(F.instr(F.lit(alphabet), c) > 0, within(alphabet)).otherwise(c)
    return (
        F.when(c.rlike("[0-9]"), within("0123456789"))
        .when(c.rlike("[a-z]"), within("abcdefghijklmnopqrstuvwxyz"))
        .when(c.rlike("[A-Z]"), within("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .otherwise(c)
    )


def permuted(s: Column, key: str, kind: str, tweak: Column, alphabet: str | None = None) -> Column:
    """A keyed bijection on strings of one format: classes of symbols, or with ``alphabet`` a length."""

    def forwards(text: Column, shape: Column, tweak: Column, turn: str) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
            F.lit(""),
            lambda done, i: F.concat(
                done,
                let2(
                    _char(text, i),
                    _number(key, F.lit(f"{kind}|{turn}|"), tweak, F.lit("|"), shape, F.lit("|"), done),
                    lambda c, by: _shifted(c, by, alphabet),
                ),
            ),
        )

    def shape_of(text: Column) -> Column:
        if alphabet:
            return F.length(text).cast("string")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")

    def once(text: Column, tweak: Column, turn: str) -> Column:
        return let(
            F.struct(text.alias("t"), shape_of(text).alias("s"), tweak.alias("k")),
            lambda v: forwards(v["t"], v["s"], v["k"], turn),
        )

    return let(tweak, lambda k: F.reverse(once(F.reverse(once(s, k, "1")), k, "2")))


def _cased(surrogate: Column, like: Column) -> Column:
    """Upper case where ``like`` has it."""
    return let2(
        surrogate,
        like,
        lambda s, x: F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
                lambda i: F.when(_char(x, i).rlike(r"\p{Lu}"), F.upper(_char(s, i))).otherwise(_char(s, i)),
            ),
            "",
        ),
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    def of(digits: Column) -> Column:
        def doubled(d: Column) -> Column:
            return F.pmod(d * 2, F.lit(10)) + F.floor(d / 5).cast("int")

        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
            F.lit(0),
            lambda acc, i: F.pmod(
                acc
                + let(
                    F.coalesce(_char(digits, i).try_cast("int"), F.lit(0)),
                    lambda d: F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, d).otherwise(doubled(d)),
                ),
                F.lit(10),
            ),
        )

    return let(digits, of)


def _refilled(like: Column, digits: Column, skip: Column) -> Column:
    """``like`` with its digits, but for the first ``skip``, replaced by ``digits`` in turn."""

    def of(like: Column, digits: Column, skip: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(like), F.lit(1))),
            F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
            lambda acc, i: let2(
                _char(like, i),
                _char(like, i).rlike("[0-9]"),
                lambda c, digit: F.struct(
                    F.concat(
                        acc["out"], F.when(digit & (acc["n"] >= skip), _char(digits, acc["n"] - skip + 1)).otherwise(c)
                    ).alias("out"),
                    (acc["n"] + digit.cast("int")).alias("n"),
                ),
            ),
            lambda acc: acc["out"],
        )

    return let(
        F.struct(like.alias("l"), digits.alias("d"), skip.alias("s")), lambda v: of(v["l"], v["d"], v["s"])
    )


def _script(part: Column) -> Column:
    return F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(entity.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(entity.rlike(rf"^(?:{IP})$"), "ip")
        .when(entity.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(entity.rlike(rf"^(?:{CARD})$"), "card")
        .otherwise("name")
    )


def is_entity(match: Column) -> Column:
    """Whether a match is one: a card number's last digit must be right, all else is by its form."""
    return ~(kind_of(match) == "card") | (_luhn(F.regexp_replace(match, "[^0-9]", "")) == 0)


def _name_fields(entity: Column) -> dict[str, Column]:
    title = F.regexp_extract(entity, rf"^({FEMALE}|{MALE}|{EITHER})", 1)
    gender = F.when(title.rlike(f"^(?:{FEMALE})$"), "female").when(title.rlike(f"^(?:{MALE})$"), "male").otherwise("either")
    lead = F.regexp_extract(entity, rf"^({TITLE}{INITIALS})(?={PART})", 1)
    rest = F.substring(entity, F.length(lead) + 1, F.length(entity))
    parts = F.split(rest, "[ \\u00a0]")
    gaps = F.regexp_extract_all(rest, F.lit("[ \\u00a0]"), F.lit(0))
    return {"lead": lead, "gender": gender, "parts": parts, "gaps": gaps}


def atoms(entity: Column) -> Column:
    """What of an entity has a surrogate of its own: array of (kind, norm)."""
    return let2(entity, kind_of(entity), _atoms)


def _atoms(entity: Column, kind: Column) -> Column:
    n = _name_fields(entity)

    def atom(kind: Column, norm: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"))

    low, digits = F.lower(entity), F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(
            kind == "email",
            F.array(
                atom(F.lit("local"), low),
                atom(F.lit("domain"), F.element_at(F.split(low, "@"), -1)),
            ),
        )
        .when(
            kind == "name",
            F.transform(
                n["parts"],
                lambda p, i: atom(F.when(i + 1 < F.size(n["parts"]), F.concat(F.lit("given-"), n["gender"])).otherwise("family"), F.lower(p)),
            ),
        )
        .when(kind == "phone", F.array(atom(kind, F.concat(F.regexp_extract(entity, r"^(\+[0-9]{1,3})", 1), F.lit(":"), F.regexp_replace(F.regexp_replace(entity, r"^\+[0-9]{1,3}", ""), "[^0-9]", "")))))
        .when(kind.isin("card", "ssn"), F.array(atom(kind, digits)))
        .when(kind == "secret", F.array(atom(kind, entity)))
        .otherwise(F.array(atom(kind, low)))
    )


def atom_surrogate(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate of one atom, keyed by ``key`` and the attempt."""
    return let(
        F.struct(kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt")),
        lambda v: _atom_surrogate(v["kind"], v["norm"], key, v["attempt"]),
    )


def _atom_surrogate(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    tweak = attempt.cast("string")

    def named(script: str, ending: Column) -> Column:
        table = F.split(F.lit(" ".join(SYLLABLES[script])), " ")
        pick = lambda i: F.element_at(
            table, (F.pmod(_number(key, kind, F.lit("|"), norm, F.lit("|"), tweak, F.lit("|"), i.cast("string")), F.lit(len(SYLLABLES[script]))) + 1).cast("int")
        )
        # A part of its length, one syllable more at each further attempt.
        count = F.greatest(F.lit(2), F.floor(F.length(norm) / 3).cast("int")) + attempt
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), count), pick), ""), ending)

    def by_script(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in SYLLABLES:
            ending = F.lit(ENDINGS[s]["family"])
            for which in ("female", "male", "either"):
                ending = F.when(kind == f"given-{which}", ENDINGS[s][which]).otherwise(ending)
            out = F.when(_script(norm) == s, named(s, ending)).otherwise(out)
        return out

    octets = F.split(norm, r"\.")
    masked = F.array_join(
        F.transform(
            octets,
            lambda o, i: F.pmod(
                F.coalesce(o.try_cast("int"), F.lit(0)) + _number(key, F.lit("ip|"), tweak, F.lit("|"), F.array_join(F.slice(octets, F.lit(1), i), ".")),
                F.lit(256),
            ).cast("string"),
        ),
        ".",
    )
    head = F.substring(norm, F.lit(1), F.length(norm) - 1)
    card = let(
        permuted(head, key, "card", tweak),
        lambda body: F.concat(body, F.pmod(_luhn(norm) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")),
    )
    start = F.regexp_extract(norm, f"^({KEY_STARTS})", 1)
    secret = (
        F.when(start != "", F.concat(start, permuted(F.substring(norm, F.length(start) + 1, F.length(norm)), key, "secret", tweak)))
        .when(norm.rlike("[A-F]"), permuted(norm, key, "secret", tweak, "0123456789ABCDEF"))
        .otherwise(permuted(norm, key, "secret", tweak, "0123456789abcdef"))
    )
    local = F.regexp_replace(norm, "@.*$", "")
    top = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    country, rest = F.substring_index(norm, ":", 1), F.substring_index(norm, ":", -1)
    return (
        F.when(kind == "local", permuted(local, key, "local", F.concat(tweak, F.lit("|"), F.regexp_replace(norm, "^[^@]*@", ""))))
        .when(kind == "domain", F.concat(permuted(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), key, "domain", tweak), top))
        .when(kind == "secret", secret)
        .when(kind == "ip", masked)
        .when(kind == "phone", F.concat(country, F.lit(":"), permuted(rest, key, "phone", F.concat(tweak, country))))
        .when(kind == "card", card)
        .when(kind == "ssn", permuted(norm, key, "ssn", tweak))
        .otherwise(by_script(kind))
    )


def _whole(kind: Column, norm: Column, surrogate: Column) -> Column:
    """What two atoms must not share: a mailbox counts with its own domain."""
    return F.when(kind == "local", F.concat(surrogate, F.lit("@"), F.regexp_replace(norm, "^[^@]*@", ""))).otherwise(surrogate)


def _attempt(atom: Column, attempts: Column | None) -> Column:
    if attempts is None:
        return F.lit(0)
    return F.coalesce(attempts[F.concat(atom["kind"], F.lit("|"), atom["norm"])], F.lit(0))


def _capitals(s: Column, like: Column) -> Column:
    """A name in capitals, or with a first capital, as ``like`` is."""
    first = F.concat(F.upper(_char(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s)))
    return F.when(like == F.upper(like), F.upper(s)).otherwise(first)


def _assembled(entity: Column, kind: Column, parts: Column) -> Column:
    """The entity with its atoms' surrogates in their places."""
    n = _name_fields(entity)
    names = F.zip_with(parts, n["parts"], _capitals)
    name = F.concat(
        n["lead"], names[0], F.array_join(F.zip_with(n["gaps"], F.slice(names, F.lit(2), F.size(n["gaps"])), lambda g, p: F.concat(g, p)), "")
    )
    return (
        F.when(kind == "email", _cased(F.concat(parts[0], F.lit("@"), F.element_at(parts, -1)), entity))
        .when(kind == "phone", _refilled(entity, F.substring_index(parts[0], ":", -1), F.length(F.regexp_extract(entity, r"^\+([0-9]{1,3})", 1))))
        .when(kind.isin("card", "ssn"), _refilled(entity, parts[0], F.lit(0)))
        .when(kind == "name", name)
        .otherwise(parts[0])
    )


def _matches(text: Column, pattern: str = ENTITY) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def surrogate_table(texts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, surrogate) of every distinct atom, without collisions."""
    found = texts.filter(F.col("text").rlike(HINT)).select(F.explode(F.array_distinct(_matches(F.col("text")))).alias("e"))
    table = (
        found.distinct().filter(is_entity(F.col("e"))).select(F.explode(atoms(F.col("e"))).alias("a"))
        .select("a.kind", "a.norm").distinct().withColumn("attempt", F.lit(0))
    )
    real = None
    while True:
        table = staged(
            table.withColumn("surrogate", atom_surrogate(F.col("kind"), F.col("norm"), key, F.col("attempt"))).withColumn(
                "whole", _whole(F.col("kind"), F.col("norm"), F.col("surrogate"))
            ),
            "surrogates",
        )
        if real is None:
            real = table.select(F.col("norm").alias("whole")).distinct()
        space = F.regexp_replace(F.col("kind"), "-.*", "")
        first = table.withColumn("space", space).groupBy("space", "whole").agg(F.min("norm").alias("first"), F.count(F.lit(1)).alias("n"))
        twice = first.filter("n > 1").select("space", "whole", "first")
        lost = (
            table.withColumn("space", space).join(twice, ["space", "whole"]).filter("norm <> first").select("kind", "norm")
            .unionByName(table.join(real, "whole", "left_semi").select("kind", "norm"))
            .distinct()
        )
        lost = staged(lost, "collisions")
        if lost.isEmpty():
            return table.drop("whole")
        again = lost.withColumn("again", F.lit(1))
        table = table.join(again, ["kind", "norm"], "left").select(
            "kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")
        )


def _matched(match: Column, known: Column) -> Column:
    """Struct of a match, its kind and its atoms: a bare word has the atom of the text's name that it is part of, if any."""
    kind = F.when(match.rlike(rf"^{WORD}$") & ~match.rlike(rf"^{NAME}$"), "word").otherwise(kind_of(match))

    def of(m: Column) -> Column:
        # The family name, if the word is one, before a given name.
        same = F.filter(known, lambda a: a["norm"] == F.lower(m["e"]))
        own = F.when(m["k"] == "word", F.slice(F.concat(F.filter(same, lambda a: a["kind"] == "family"), same), 1, 1)).otherwise(_atoms(m["e"], m["k"]))
        entity = (m["k"] != "card") | (_luhn(F.regexp_replace(m["e"], "[^0-9]", "")) == 0)
        return F.struct(m["e"].alias("e"), m["k"].alias("k"), F.when(entity, own).otherwise(F.slice(own, 1, 0)).alias("a"))

    return let(F.struct(match.alias("e"), kind.alias("k")), of)


def replaced(text: Column, key: str, attempts: Column | None = None) -> Column:
    """Struct of the text with surrogates and the number of entities replaced; ``attempts`` maps 'kind|norm' to an attempt over 0.

    A text is matched once, and cut at the matches if there are any; one with a name is matched again with its capitalised words.
    """
    plain = F.struct(text.alias("text"), F.lit(0).alias("n"))

    def filled(v: Column) -> Column:
        def surrogate(m: Column) -> Column:
            parts = F.transform(m["a"], lambda a: atom_surrogate(a["kind"], a["norm"], key, _attempt(a, attempts)))
            whole = let(parts, lambda p: F.when(m["k"] == "word", _capitals(p[0], m["e"])).otherwise(_assembled(m["e"], m["k"], p)))
            return F.struct(F.when(F.size(m["a"]) > 0, whole).otherwise(m["e"]).alias("e"), (F.size(m["a"]) > 0).cast("int").alias("n"))

        each = F.transform(v["found"], lambda e: let(_matched(e, v["known"]), surrogate))
        return let2(
            each,
            v["gaps"],
            lambda each, gaps: F.struct(
                F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(each)), each, lambda g, x: F.concat(g, x["e"])), ""), F.element_at(gaps, -1)).alias("text"),
                F.aggregate(each, F.lit(0), lambda acc, x: acc + x["n"]).alias("n"),
            ),
        )

    def cut(found: Column) -> Column:
        names = F.filter(found, lambda e: kind_of(e) == "name")
        named = F.size(names) > 0
        parts = F.struct(
            F.when(named, _matches(text, ENTITY_OR_WORD)).otherwise(found).alias("found"),
            F.when(named, F.split(text, ENTITY_OR_WORD, -1)).otherwise(F.split(text, ENTITY, -1)).alias("gaps"),
            F.array_distinct(F.flatten(F.transform(names, lambda e: _atoms(e, F.lit("name"))))).alias("known"),
        )
        return F.when(F.size(found) > 0, let(parts, filled)).otherwise(plain)

    return F.when(text.rlike(HINT), let(_matches(text), cut)).otherwise(plain)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many trailing underscores as it needs to be none of ``taken`` (case aside, as Spark compares names)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", literal_limit: int = 500) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the number of entities as ``n_entities``."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    again = surrogate_table(texts, key).filter("attempt > 0").select(F.concat("kind", F.lit("|"), "norm").alias("k"), "attempt")
    few = again.limit(literal_limit + 1).collect()
    text = F.col(f"`{text_col}`").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    at, maps_col, made = (free_name(c, docs.columns) for c in ("_tidemark_at", "_tidemark_attempts", "_tidemark_made"))
    count = free_name("n_entities", docs.columns)

    def finished(rows: DataFrame, attempts: Column | None) -> DataFrame:
        # A generator is evaluated once a row, whatever reads its fields.
        rows = rows.select(*others, F.explode(F.array(replaced(text, key, attempts))).alias(made))
        return rows.select(*others, F.col(f"{made}.text").alias(text_col), F.col(f"{made}.n").alias(count))

    if len(few) <= literal_limit:
        return finished(docs, F.create_map(*[F.lit(x) for r in few for x in (r["k"], r["attempt"])]) if few else None)
    uses = (
        docs.filter(text.rlike(HINT)).select(F.xxhash64(text).alias(at), F.explode(_matches(text)).alias("e"))
        .select(at, F.explode(atoms(F.col("e"))).alias("a"))
        .select(at, F.concat("a.kind", F.lit("|"), "a.norm").alias("k")).distinct()
    )
    maps = uses.join(again, "k").groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias(maps_col))
    named = docs.withColumn(at, F.xxhash64(text)).join(maps, at, "left")
    with_map, without = named.filter(F.col(maps_col).isNotNull()), named.filter(F.col(maps_col).isNull())
    return finished(with_map, F.col(maps_col)).unionByName(finished(without, None))


_DRAWN: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that is set, else one that is drawn for the application."""
    drawn = _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return spark.conf.get("spark.tidemark.surrogates.key", None) or drawn


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
