"""Surrogates for personal data, in DataFrame functions alone.

Entities are found by one pattern: mail and network addresses, phone, card, social security and bank
numbers, keys and passwords, and up to four names after one or more titles. Each is replaced by a surrogate of its kind
and format that a keyed digest of the entity decides, so that the same entity has the same surrogate
in all documents, however it is written (case, separators), and nobody without the key can tell
which entity it stands for. A name keeps its title, script and case, and the given name its gender
(the title's); given and family names are mapped apart, so that "Mr. X" and "Mr. Y X" still agree.

Within a document a name that was found after a title is replaced wherever it stands again, with a
title or without, as a whole word and spelt alike. A given name that has a gendered title somewhere in
the document keeps that gender's surrogate after a degree ("Dr.") too. A name that never follows a title
in its document is not found.

Collision checks: all distinct entities of the corpus are gathered (combining before the shuffle),
and a surrogate must not be the surrogate of another entity, nor occur as an entity itself.
Whatever collides gets a further digest, in rounds, until nothing does. Documents need the outcome
only for entities that needed a further digest. These are few, and a written table joins them to the
documents that hold them, by the text's digest; texts are shuffled only if that table is too large to
be sent around.

Formats: a card number keeps length, first digit and whether its check digit is right; a phone
number its country code and punctuation; public addresses become reserved ones (240.0.0.0/4),
private ones stay in 10.0.0.0/8, those of version 6 become 2001:db8::/32; social security numbers get the unassigned 9xx; mail addresses get
domains below `.example.`; keys keep their alphabet by character and known prefixes.

Nulls: a null text stays null. Rows come out one for one with all their columns, repeated or null ids
too. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging

MOST_ROUNDS = 50

_WORD = r"\p{L}\p{N}"
_MALE = "Mr|Herrn?|Señor|Sr|Monsieur|Signor|господин|г-н|κύριος|κ"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Mlle|Signora|госпожа|г-жа|κυρία|κα"
_NEUTRAL = "Dr|Prof|Professor|Professorin|Doctor|Doktor"
_TITLE = rf"(?:(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? )+"
_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}\p{L}+)?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: (kind, where it is found, what tells it from other found texts), most special first.
PATTERNS = [
    ("mail", rf"(?<![{_WORD}._%+\-])[._%+\-]*+[{_WORD}][{_WORD}._%+\-]*+@(?:[{_WORD}\-]+\.)+\p{{L}}{{2,24}}", r"@"),
    ("address", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    ("address6", rf"(?<![{_WORD}:])(?:(?:{_HEX}:){{7}}{_HEX}"
                 rf"|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![{_WORD}]|:[0-9A-Fa-f])",
     r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"),
    ("security", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", r"^\d{3}-\d{2}-\d{4}$"),
    ("secret", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
     r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64})$"),
    ("card", r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
     r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})$"),
    ("phone", rf"(?<![{_WORD}])\+1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d)"
              rf"|(?<![{_WORD}+])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])|(?<![\d.])\d{{3}}\.\d{{3}}\.\d{{4}}(?!\d|\.\d)"
              rf"|(?<![{_WORD}])\+(?!1[ .(-])\d{{1,3}}(?:[ .-]\(?\d{{2,4}}\)?){{2,4}}(?!\d)", r"^[+(]|^\d{3}([.-])\d{3}\1\d{4}$"),
    ("bank", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?| ?\d{4} ?\d{4} ?\d{3})(?![A-Za-z0-9])", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9])+$"),
    ("name", rf"(?<!\p{{L}}){_TITLE}{_NAME}(?: {_NAME}){{0,3}}", rf"^{_TITLE}\p{{Lu}}"),
    ("secret", r"(?:(?<=[=:\"'])|(?<=[=:] ))(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key) ?[=:] ?[\"']?)"
               r"[A-Za-z0-9_+/\-]{6,}", r"."),
]


def _pattern() -> str:
    """One pattern of all kinds. What begins with a word is only tried where a word begins, and
    numbers only at digits, since most places of a text are neither."""
    numbers = {"address", "security", "card"}
    words = "|".join(f"(?:{p})" for k, p, _ in PATTERNS[:-1] if k not in numbers)
    digits = "|".join(f"(?:{p})" for k, p, _ in PATTERNS if k in numbers)
    return rf"(?<![{_WORD}])(?:{words})|(?=\d)(?:{digits})|{PATTERNS[-1][1]}"


PATTERN = _pattern()

_SYLLABLES = {  # consonants, vowels, ends of male and of female given names
    "latin": ("bdfgklmnprstvzhj", "aeiouaeiouaeioua", "n", "a"),
    "cyrillic": ("бдгзклмнпрстфвхж", "аеиоуаеиоуаеиоуа", "н", "а"),
    "greek": ("βγδζθκλμνπρσταφχ", "αειουαειουαειουα", "ς", "α"),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(hexes: Column, at: Column | int, size: int) -> Column:
    """A number from `size` hex digits from place `at` on."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hexes, at, F.lit(size)), 16, 10).cast("bigint")


def _pick(letters: str | Column, number: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, (F.pmod(number, F.length(letters).cast("bigint")) + 1).cast("int"), F.lit(1))


def _shaped(value: Column, hexes: Column) -> Column:
    """Digits for digits, letters for letters of the same case (hex digits if all are), the rest as it is."""
    def one(c: Column, i: Column, all_hex: Column, hexes: Column) -> Column:
        n = _number(hexes, F.pmod(i * 2, F.lit(250)) + 1, 2)
        return _pick(
            F.when(all_hex, "0123456789abcdef").when(c.rlike("^[0-9]$"), "0123456789").when(
                c.rlike(r"^\p{Lu}$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").when(
                c.rlike(r"^\p{L}$"), "abcdefghijklmnopqrstuvwxyz").otherwise(c), n)

    bound = F.struct(value.alias("value"), hexes.alias("hexes"), value.rlike("^[0-9a-f]*[a-f][0-9a-f]*$").alias("hex"))
    return _let(bound, lambda v: F.array_join(F.transform(
        F.split(v["value"], ""), lambda c, i: one(c, i, v["hex"], v["hexes"])), ""))


def _check_sum(digits: Column) -> Column:
    """Luhn's sum modulo 10 of digits, the last one included."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(norm: Column, hexes: Column) -> Column:
    body = F.concat(F.substring(norm, 1, 1), F.substring(_shaped(norm, hexes), F.lit(2), F.length(norm) - 2))

    def checked(v: Column) -> Column:
        right = v["valid"] == 0
        return F.concat(v["body"], ((v["check"] + F.when(right, 0).otherwise(1 + F.pmod(v["other"], F.lit(9)))) % 10).cast("string"))

    check = _let(body, lambda b: F.struct(b.alias("body"), ((10 - _check_sum(F.concat(b, F.lit("0")))) % 10).alias("check")))
    return _let(F.struct(check.alias("c"), _check_sum(norm).alias("valid"), _number(hexes, 240, 4).cast("int").alias("other")),
                lambda v: _let(F.struct(v["c"]["body"].alias("body"), v["c"]["check"].alias("check"),
                                        v["valid"].alias("valid"), v["other"].alias("other")), checked))


def _octets(hexes: Column, first: Column) -> Column:
    rest = [F.pmod(_number(hexes, 10 + 4 * i, 4), F.lit(256)).cast("string") for i in range(3)]
    return F.concat_ws(".", first.cast("string"), *rest)


def _address(norm: Column, hexes: Column) -> Column:
    private = norm.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01])|127)\.")
    return _octets(hexes, F.when(private, F.lit(10)).otherwise(240 + F.pmod(_number(hexes, 1, 4), F.lit(15)).cast("int")))


def _address6(hexes: Column) -> Column:
    """In the range for documentation, 2001:db8::/32."""
    return F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(hexes, 5 + 4 * i, 4) for i in range(6)])


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, written out."""
    def own(text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def full(halves: Column) -> Column:
        left, right = own(F.get(halves, F.lit(0))), own(F.get(halves, F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")

    return _let(F.split(F.lower(address), "::"), full)


def _phone(norm: Column, hexes: Column) -> Column:
    lead = lambda at: _pick("23456789", _number(hexes, at, 4))

    def made(digits: Column) -> Column:
        american = F.concat(lead(200), F.substring(digits, 2, 2), lead(210), F.substring(digits, 5, 6))
        # The country code is the first one to three digits; two are kept.
        return F.when(norm.rlike(r"^1\d{10}$"), _text("1", american)).when(F.length(norm) == 10, american).otherwise(
            F.concat(F.substring(norm, 1, 2), F.substring(digits, F.lit(3), F.length(norm))))

    return _let(_shaped(norm, hexes), made)


def _mail(norm: Column, hexes: Column) -> Column:
    local = F.regexp_replace(F.substring_index(norm, "@", 1), r"[^\x00-\x7F]", "x")
    # Short names get letters, or there would be too few of them.
    shaped = _let(local, lambda x: _shaped(F.concat(F.repeat(F.lit("x"), F.greatest(F.lit(0), 8 - F.length(x))), x), hexes))
    domain = F.sha2(_text(F.substring(hexes, 1, 8), F.substring_index(norm, "@", -1)), 256)
    return _let(domain, lambda d: _text(
        shaped, "@", _pick("bcdfghjklmnprst", _number(d, 1, 4)), F.translate(F.substring(d, 5, 5), "0123456789", "ghijklmnop"),
        ".example.", F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (F.pmod(_number(d, 20, 4), F.lit(3)) + 1).cast("int"))))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(norm: Column, hexes: Column, end: int | None) -> Column:
    """Syllables of the name's script, of about its length, in lower case."""
    script = _script(norm)

    def of_script(place: int) -> Column:
        out = F.lit(_SYLLABLES["latin"][place])
        for name in ("cyrillic", "greek"):
            out = F.when(script == name, _SYLLABLES[name][place]).otherwise(out)
        return out

    def syllable(i: Column) -> Column:
        return F.concat(_pick(of_script(0), _number(hexes, i * 4 + 1, 2)), _pick(of_script(1), _number(hexes, i * 4 + 3, 2)))

    number = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(F.length(norm) / 2).cast("int")))
    made = F.array_join(F.transform(F.sequence(F.lit(0), number - 1), syllable), "")
    return made if end is None else F.concat(made, of_script(end))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    def made(v: Column) -> Column:
        kind, norm, hexes = v["kind"], v["norm"], v["hexes"]
        shaped = v["shaped"]
        rest = lambda n: F.substring(shaped, F.lit(n), F.length(norm))
        return F.when(kind == "mail", _mail(norm, hexes)).when(kind == "address", _address(norm, hexes)).when(
            kind == "address6", _address6(hexes)).when(
            kind == "security", _text("9", rest(2))).when(
            kind == "card", _card(norm, hexes)).when(kind == "phone", _phone(norm, hexes)).when(
            kind == "bank", F.concat(F.substring(norm, 1, 2), rest(3))).when(
            kind == "secret", F.when(norm.rlike("^(?:AKIA|ASIA|gh[pousr]_)"), F.concat(F.substring(norm, 1, 4), rest(5))).otherwise(shaped)).when(
            kind == "male", _name(norm, hexes, 2)).when(kind == "female", _name(norm, hexes, 3)).otherwise(_name(norm, hexes, None))

    seed = _text(key, "|", kind, "|", norm, "|", attempt.cast("string"))
    seeded = _let(seed, lambda x: F.concat(F.sha2(x, 512), F.sha2(_text(x, "|2"), 512)))
    first = F.struct(kind.alias("kind"), norm.alias("norm"), seeded.alias("hexes"))
    return _let(first, lambda v: _let(F.struct(
        v["kind"].alias("kind"), v["norm"].alias("norm"), v["hexes"].alias("hexes"),
        _shaped(v["norm"], v["hexes"]).alias("shaped")), made))


def _kind(found: Column) -> Column:
    out = F.lit("secret")
    for kind, _, told in reversed(PATTERNS[:-1]):
        out = F.when(found.rlike(told), kind).otherwise(out)
    return out


def _given(found: Column) -> Column:
    """Gender of the titles; none for a degree alone."""
    titles = F.regexp_extract(found, f"^{_TITLE}", 0)
    told = lambda names: titles.rlike(rf"(?:^| )(?:{names})\.? ")
    return F.when(told(_FEMALE), "female").when(told(_MALE), "male").otherwise("given")


def _names(found: Column) -> Column:
    """The name words after the titles, the family name last."""
    return F.split(F.regexp_replace(found, f"^{_TITLE}", ""), " ")


def _lead(found: Column) -> Column:
    """Signs before a mail address that are no part of it."""
    return F.regexp_extract(found, r"^[._%+\-]*", 0)


def entity_parts(found: Column) -> Column:
    """[(kind, normal form)] of a found text; one for each name after a title."""
    part = lambda k, n: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), n.alias("norm"))

    def parts(v: Column) -> Column:
        kind, text, words = v["kind"], v["text"], v["words"]
        names = F.transform(words, lambda w, i: part(
            F.when(i == F.size(words) - 1, "family").otherwise(v["given"]), F.lower(w)))
        norm = F.when(kind.isin("card", "phone", "security"), F.regexp_replace(text, r"[^0-9]", "")).when(
            kind == "mail", F.lower(F.regexp_replace(text, r"^[._%+\-]+", ""))).when(
            kind == "address6", _groups(text)).when(
            kind == "bank", F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)
        return F.when(kind == "name", names).otherwise(F.array(part(kind, norm)))

    return _let(F.struct(_kind(found).alias("kind"), found.alias("text"), _names(found).alias("words"),
                         _given(found).alias("given")), parts)


def _as_found(shown: Column, made: Column, wanted: str) -> Column:
    """`made`'s characters in the places of `shown` that match `wanted`, in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(wanted)
        return F.struct(F.concat(s["out"], F.when(own, F.substring(made, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(shown, ""), start, step, lambda s: s["out"])


def _cased(shown: Column, made: Column) -> Column:
    """Capitals as in the name shown."""
    return F.when((F.length(shown) > 1) & (shown == F.upper(shown)), F.upper(made)).otherwise(F.initcap(made))


def rendered(found: Column, attempts: Column | None, key: str) -> Column:
    """The text that stands for a found one."""
    def made(part: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(
            F.element_at(attempts, _text(part["kind"], "|", part["norm"])), F.lit(0))
        return surrogate(part["kind"], part["norm"], attempt, key)

    def shown(v: Column) -> Column:
        kind, text, words, out = v["kind"], v["text"], v["words"], v["out"]
        one = F.element_at(out, 1)
        name = F.concat(F.regexp_extract(text, f"^{_TITLE}", 0), F.array_join(F.zip_with(words, out, _cased), " "))
        return F.when(kind == "name", name).when(
            kind.isin("card", "phone", "security"), _as_found(text, one, "^[0-9]$")).when(
            kind == "bank", _as_found(text, one, "^[^ ]$")).when(
            kind == "mail", F.concat(_lead(text), F.when(text == F.upper(text), F.upper(one)).otherwise(one))).otherwise(one)

    return _let(F.struct(_kind(found).alias("kind"), found.alias("text"), _names(found).alias("words"),
                         F.transform(entity_parts(found), made).alias("out")), shown)


def told_names(found: Column | str, made: Column | str) -> Column:
    """[(word, made)] of the names in found texts and what stands for them; those of gendered titles first."""
    def pairs(f: Column, m: Column) -> Column:
        own = F.zip_with(_names(f), _names(m), lambda w, s: F.struct(w.alias("word"), s.alias("made")))
        return F.struct((_given(f) != "given").alias("told"), F.when(_kind(f) == "name", own).otherwise(F.array().cast(
            "array<struct<word:string,made:string>>")).alias("pairs"))

    def ordered(all_: Column) -> Column:
        first = F.filter(all_, lambda p: p["told"])
        return F.flatten(F.transform(F.concat(first, F.filter(all_, lambda p: ~p["told"])), lambda p: p["pairs"]))

    return _let(F.zip_with(found, made, pairs), ordered)


def _stands_for(word: Column, names: Column) -> Column:
    return F.coalesce(F.get(F.filter(names, lambda n: n["word"] == word), F.lit(0))["made"], word)


def _of_document(names: Column) -> Callable[[Column, Column], Column]:
    """What stands for a found text: after a degree alone, names have what the document's other titles give."""
    def one(found: Column, made: Column) -> Column:
        degree = (_kind(found) == "name") & (_given(found) == "given")
        words = F.transform(_names(found), lambda w: _stands_for(w, names))
        return F.when(degree, F.concat(F.regexp_extract(found, f"^{_TITLE}", 0), F.array_join(words, " "))).otherwise(made)

    return one


def renamed(text: Column, names: Column) -> Column:
    """A text with the names replaced where they stand as whole words."""
    words = F.array_join(F.array_distinct(F.transform(names, lambda n: n["word"])), "|")  # letters, ' and - alone
    pattern = _text(rf"(?<![{_WORD}'’-])(?:", words, rf")(?![{_WORD}])")

    def woven(v: Column) -> Column:
        hits = F.regexp_extract_all(v["text"], v["pattern"], F.lit(0))
        made = F.transform(hits, lambda w: _stands_for(w, names))
        return F.array_join(F.zip_with(F.split(v["text"], v["pattern"], -1), made, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")

    return _let(F.struct(text.alias("text"), pattern.alias("pattern")), lambda v: F.when(
        F.regexp_like(v["text"], v["pattern"]), woven(v)).otherwise(v["text"]))


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def entities(documents: DataFrame) -> DataFrame:
    """(kind, norm): the distinct entities of all texts."""
    found = documents.select(F.explode(matches(F.col("text"))).alias("found")).distinct()
    return found.select(F.explode(entity_parts(F.col("found"))).alias("part")).select("part.*").distinct()


def collisions(known: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt) of entities that need a further digest; None if there are none."""
    current = known.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ROUNDS):
        made = staging.stage(current.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)))
        # The entity of the least attempts keeps a surrogate that several have.
        first = made.groupBy("kind", "made").agg(
            F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
            "kind", "made", F.col("first.norm").alias("keeps"))
        real = known.select("kind", F.col("norm").alias("made"), F.lit(True).alias("real"))
        judged = made.join(first, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        lost = (F.col("keeps").isNotNull() & (F.col("keeps") != F.col("norm"))) | F.coalesce("real", F.lit(False))
        judged = staging.stage(judged.select("kind", "norm", "attempt", lost.alias("lost")))
        if judged.where("lost").isEmpty():
            changed = judged.where("attempt > 0").select("kind", "norm", "attempt")
            return None if changed.isEmpty() else changed
        current = judged.select("kind", "norm", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise ValueError("no free surrogates are left for some kind of entity")


def replace(documents: DataFrame, key: str) -> DataFrame:
    """`documents` with surrogates in their texts, n_entities and the kinds found.

    All columns of `documents` are kept; the three named ones are added or replaced.
    """
    kept = [c for c in documents.columns if c not in ("n_entities", "kinds")]
    if len(set(kept)) != len(kept):
        raise ValueError("column names must differ")
    known = staging.stage(entities(staging.plain(documents, {"text": "string"})))
    changed = collisions(known, key)
    out, attempts = documents.select(*kept), None
    if changed is not None:
        digest = F.xxhash64("text")
        held = staging.plain(documents, {"text": "string"}).where(F.size(matches(F.col("text"))) > 0).select(
            digest.alias("text_digest"), F.explode(matches(F.col("text"))).alias("found")).select(
            "text_digest", F.explode(entity_parts(F.col("found"))).alias("part")).select("text_digest", "part.*").distinct()
        fixes = staging.stage(held.join(changed, ["kind", "norm"]).groupBy("text_digest").agg(
            F.map_from_entries(F.collect_list(F.struct(_text(F.col("kind"), "|", F.col("norm")), "attempt"))).alias("attempts")))
        out = out.withColumn("text_digest", digest).join(fixes, "text_digest", "left").drop("text_digest")
        attempts = F.coalesce("attempts", F.create_map().cast("map<string,int>"))
    out = out.withColumn("found", matches(F.col("text")))
    surrogates = F.transform("found", lambda m: rendered(m, attempts, key))
    out = out.withColumns({"made": surrogates, "between": F.split("text", PATTERN, -1)})
    # Names that a document tells by titles, gendered ones first: (word, what stands for it).
    out = out.withColumn("names", F.when(F.exists("found", lambda m: _kind(m) == "name"), told_names("found", "made")))
    woven = F.zip_with("between", "made", lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    again = F.zip_with(
        F.transform("between", lambda g: renamed(g, F.col("names"))), F.zip_with("found", "made", _of_document(F.col("names"))),
        lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    joined = F.array_join(F.when(F.col("names").isNull(), woven).otherwise(again), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    kinds = F.coalesce(F.array_sort(F.array_distinct(F.transform("found", _kind))), F.array().cast("array<string>"))
    return out.select(*[(text.alias(c) if c == "text" else F.col(c)) for c in kept],
                      F.greatest(F.size("found"), F.lit(0)).alias("n_entities"), kinds.alias("kinds"))
