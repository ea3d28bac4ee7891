"""PII: surrogate generation. Detected entities get keyed replacements of the same type, script, gender and format; one
entity has one surrogate throughout all documents, and different entities have different ones.

Detected are e-mail addresses, IPv4 and IPv6 addresses, payment cards, IBANs, telephone and social security numbers, secrets
(long hexadecimal keys, keys with a known prefix, values after a label such as `password=`, PEM private keys) and names after
a title; in a document with such a name also its words standing alone (`Mr John Smith ... Smith`).

A mention's *form* is its type and what its spellings have in common: lower case, digits without separators, and for names
each word by itself, so that `Mr John Smith`, `Dr Smith` and `Smith` share what they share. The form and the key decide the
surrogate, which is then written in the mention's own format: letters become letters of the same script, digits digits,
everything else stays; card numbers and IBANs keep valid check digits, IP addresses stay addresses, e-mails keep their last
label, telephones their country code, keys their prefix. A name's ending tells its gender: that of the titles that its
bearers have (`i` if they have both), else that of its own ending.

Draws can collide, with each other or with an entity that really occurs. All forms' first draws are compared; those that
collide draw again, round by round, against what is taken, until all have one. Only where a format's space is full (eight
draws and three rounds in a row without a free one) a hexadecimal tag that contains the whole keyed digest is written.
These few exceptions go to the documents as a table, all other surrogates are computed in place. The texts are searched
once; what is found is written to the shared folder with them. Only DataFrame functions are used.

Cases: a null text stays null, an empty one empty, and so does a text without entities; very long texts are taken whole (no
pattern repeats a group without bound); rows with equal doc_id or text get equal replacements; all columns of the input are
kept, whatever their names (its own n_entities column, if any, is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm._shared import discard, written

#: What is detected (fixed values). Titles by gender, words between the words of a name, labels and prefixes of secrets.
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Г-н|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Г-жа|Κυρία"
_NEUTRAL = "Dr|Prof"
_BETWEEN = "de|del|della|di|da|dos|du|la|le|el|al|van|von|der|den|bin|ibn"
_LABEL = "(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)"
_PREFIX = "(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abeoprs]-|AIza|eyJ)"
#: Country codes of telephone numbers of one and two digits; all others have three (fixed values).
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_LATIN1 = "A-Za-z0-9À-ɏ"
_END = r"(?![A-Za-z0-9])"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:[-'’]\p{Lu}[\p{L}\p{M}]*+)*+"
_PART = rf"(?:(?:{_BETWEEN}) ){{0,2}}(?:(?:\p{{Lu}}\.){{1,3}}(?= \p{{Lu}})|{_WORD})"
TITLE = rf"(?:(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?|M\.)[  ]"
HEAD = rf"{_LABEL}[\"']?[ ]?[:=][ ]?[\"']?"
EMAIL = rf"(?<![._%+-])[{_LATIN1}._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9.-]{{0,63}}[A-Za-z]))++[A-Za-z]{{2,24}}"
HEXADECIMAL = rf"(?=[a-fA-F]{{0,128}}[0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}){_END}"
IPV6 = rf"(?<!:)(?=[A-Fa-f:]{{0,40}}[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{2,6}}(?::{_HEX4}){{1,5}})(?![A-Za-z0-9:])"
IP = rf"(?<!\.){_BYTE}(?:\.{_BYTE}){{3}}(?!\.?[0-9])"
CARD = r"(?:[0-9]{4}[ -]){3}[0-9]{4}(?:[ -][0-9]{1,3})?(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{13,19}(?![0-9])"
SOCIAL = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NATIONAL = r"(?<!-)(?:1[-. ])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9-])|0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9])|0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])"
KEY = rf"{_PREFIX}[A-Za-z0-9_-]{{16,}}+(?:\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+)?"
LABELLED = rf"{_LABEL}[\"']?[ ]?(?:=[ ]?[\"']?[^\s\"',;]{{4,200}}|:[ ]?[\"']?(?=[^\s\"',;]{{0,200}}[0-9])[^\s\"',;]{{6,200}})"
IBAN = rf"[A-Z]{{2}}[0-9]{{2}}(?=(?:[ A-Z]{{0,6}}[0-9]){{6}})(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"
NAME = rf"(?<!\p{{L}}){TITLE}{_PART}(?: {_PART}){{0,2}}"
PHONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\.?[0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: Inside a word nothing is tried but its first character's neighbours.
ENTITY = (
    rf"(?<![{_LATIN1}])(?:{EMAIL}|{HEXADECIMAL}|{IPV6}|(?=[0-9])(?:{IP}|{CARD}|{SOCIAL}|{NATIONAL})|{KEY}|{LABELLED}|(?=\p{{Lu}})(?:{IBAN}|{NAME}))"
    rf"|(?=[+(])(?:{PHONE})|(?=-)(?:{PEM})"
)

_MARK, _ESCAPE = "\x01", "\x02"
_SCRIPTS = [(r"\p{IsCyrillic}", "бвгдзклмнпрстф", "аеиоу", "а,ор,и"), (r"\p{IsGreek}", "βγδζκλμνπρστφ", "αεηιου", "α,ος,ι"), ("", "bcdfghjklmnprstvz", "aeiou", "a,o,i")]
_GENDERS = 4  # of a code: 0 by the word's own ending, 1 female, 2 male, 3 both; code = draw * 4 + gender, -1: the tag


def _let(x: Column, body) -> Column:
    """body(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def kind(e: Column) -> Column:
    return (
        F.when(e.startswith("-----"), "pem").when(e.rlike(rf"^{HEAD}"), "label").when(e.contains("@"), "email").when(e.rlike("^[0-9a-fA-F]{32,}$"), "hex")
        .when(e.rlike(rf"^{_PREFIX}[A-Za-z0-9_.-]*$"), "key").when(e.rlike(r"^[0-9]+(\.[0-9]+){3}$") & ~e.rlike("[0-9]{4}"), "ip").when(e.contains(":"), "ipv6").when(e.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(~e.rlike("[0-9]"), "name").when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social").when(e.rlike("^[0-9 -]+$") & (F.length(_digits(e)) >= 13), "card").otherwise("phone")
    )


def title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^{TITLE}", 0)


def words(e: Column) -> Column:
    """The words of a name behind its title, longer than an initial."""
    return F.regexp_extract_all(F.substr(e, F.length(title(e)) + 1), F.lit(r"\p{Lu}[\p{L}\p{M}]+"), F.lit(0))


def _form(e: Column, k: Column) -> Column:
    value = F.when(k == "label", F.regexp_replace(e, rf"^{HEAD}", "")).when(k.isin("card", "social"), _digits(e)).when(k == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), _digits(e)))
    value = value.when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(k.isin("key", "pem"), e).otherwise(F.lower(e))
    return F.concat(F.when(k == "label", "key").otherwise(k), F.lit(":"), value)


def forms(e: Column) -> Column:
    """What mentions of one entity have in common; a name has one form for each of its words."""
    one = lambda k: F.when(k == "name", F.transform(words(e), lambda w: F.concat(F.lit("name:"), F.lower(w)))).otherwise(F.array(_form(e, k)))
    return _let(kind(e), one)


# Surrogates of forms


def _at(hex_: Column, i: Column, n: int | Column) -> Column:
    """A number below n for position i, from two hexadecimal digits each."""
    return F.pmod(F.conv(F.substr(hex_, i * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int") + i, F.lit(n) if isinstance(n, int) else n)


def _pick(letters: str, hex_: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _at(hex_, i, len(letters)) + 1, F.lit(1))


def _each(e: Column, to) -> Column:
    return F.array_join(F.transform(F.split(e, ""), to), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits modulo 10."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + (d.cast("int") >= 5).cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def _number(c: Column, k: Column, h: Column) -> Column:
    """Digits for digits; a telephone's country code stays, a card's last digit checks if it did."""
    keep = F.when(c.startswith("+"), F.length(F.regexp_extract(c, rf"^\+(?:{_COUNTRY})", 0))).otherwise(F.lit(0))
    drawn = _let(keep, lambda n: _each(c, lambda d, i: F.when(i < n, d).otherwise(_at(h, i, 10).cast("string"))))
    checked = lambda x: F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when((k == "card") & (_luhn(c) == 0), _let(F.substr(drawn, F.lit(1), F.length(c) - 1), checked)).otherwise(drawn)


def _letters(c: Column, h: Column) -> Column:
    """Letters for letters of the same case, accents for accents, digits for digits; other characters stay."""
    lower, upper, accents = "abcdefghijklmnoprstuvwy", "ABCDEFGHIJKLMNOPRSTUVWY", "áàâäãåéèêëíìîïóòôöõúùûüñç"
    return _each(c, lambda x, i: F.when(x.rlike("[0-9]"), _at(h, i, 10).cast("string")).when(x.rlike("[a-z]"), _pick(lower, h, i)).when(x.rlike("[A-Z]"), _pick(upper, h, i)).when(x.rlike("[À-ɏ]"), _pick(accents, h, i)).otherwise(x))


def _between(c: Column, head: str, tail: str, body) -> Column:
    """body(the middle) between what matches head and tail, which stay."""
    a, b = F.regexp_extract(c, head, 0), F.regexp_extract(c, tail, 0)
    return F.concat(a, body(F.substr(c, F.length(a) + 1, F.length(c) - F.length(a) - F.length(b))), b)


def _iban(c: Column, h: Column) -> Column:
    """The country stays; the check digits make the number 1 modulo 97 again."""
    rest = _letters(F.substr(c, F.lit(5)), h)
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rem = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda a, x: F.when(x == "", a).when(x.rlike("[0-9]"), F.pmod(a * 10 + value(x), F.lit(97))).otherwise(F.pmod(a * 100 + value(x), F.lit(97))))
    return _let(rest, lambda r: F.concat(F.substr(c, F.lit(1), F.lit(2)), F.lpad((98 - rem(F.concat(r, F.substr(c, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), r))


def _own_gender(word: Column) -> Column:
    return F.when(word.rlike("[aаяα]$"), F.lit(1)).otherwise(F.lit(2))


def _name(c: Column, h: Column, draw: Column, gender: Column) -> Column:
    """A word of its script, two letters longer from every second draw on (up to ten), with the ending of its gender."""

    def by_script(of) -> Column:
        out = F.lit(of(_SCRIPTS[-1]))
        for script in _SCRIPTS[:-1]:
            out = F.when(c.rlike(script[0]), F.lit(of(script))).otherwise(out)
        return out

    def word(consonants: Column, vowels: Column, ends: Column) -> Column:
        pick = lambda letters, k: F.substr(letters, _at(h, k + 3, F.length(letters)) + 1, F.lit(1))
        one = lambda k: F.when(k % 2 == 1, pick(vowels, k)).otherwise(pick(consonants, k))
        sex = F.when(gender == 0, _own_gender(c)).otherwise(gender)
        more = F.least(F.floor(draw / 2), F.lit(5)).cast("int") * 2
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), more + 4), one), ""), F.split_part(ends, F.lit(","), sex))

    return word(*(by_script(lambda x, k=k: x[k]) for k in (1, 2, 3)))


def _digest(form: Column, key: str, draw: Column) -> Column:
    """128 hexadecimal digits from the key, the form and the number of the draw."""
    return _let(F.concat_ws("\x1f", F.lit(key), form, draw.cast("string")), lambda x: F.concat(F.sha2(x, 256), F.sha2(F.concat(x, F.lit("+")), 256)))


def surrogate(form: Column, key: str, code: Column) -> Column:
    """The replacement of a form, without its type."""

    def new(k: Column, c: Column, draw: Column, h: Column) -> Column:
        out = F.when(k.isin("card", "phone", "social"), _number(c, k, h)).when(k == "email", _between(c, "^", r"\.[a-z]+$", lambda x: _letters(x, h))).when(k == "name", _name(c, h, draw, F.pmod(code, F.lit(_GENDERS))))
        out = out.when(k == "hex", _each(c, lambda x, i: F.substr(h, F.pmod(i, F.lit(128)) + 1, F.lit(1)))).when(k == "ip", F.concat_ws(".", *((_at(h, F.lit(40 + j), 254) + 1).cast("string") for j in range(4))))
        out = out.when(k == "ipv6", _each(c, lambda x, i: F.when(x == ":", x).otherwise(_pick("0123456789abcdef", h, i)))).when(k == "iban", _iban(c, h))
        out = out.when(k == "key", _between(c, rf"^{_PREFIX}?", "$", lambda x: _letters(x, h))).otherwise(_between(c, "^-----[^-]*-----", "-----[^-]*-----$", lambda x: _letters(x, h)))
        return F.when(draw < 0, F.concat(F.lit("["), k, F.lit("-"), F.substr(h, F.lit(1), F.lit(64)), F.lit("]"))).otherwise(out)

    draw = F.floor(code / _GENDERS)
    return _let(F.substring_index(form, ":", 1), lambda k: _let(F.substr(form, F.length(k) + 2), lambda c: _let(_digest(form, key, draw), lambda h: new(k, c, draw, h))))


def written_as(e: Column, key: str, code) -> Column:
    """The replacement of mention e in its own format; code(form) tells a form's draw."""

    def cased(w: Column, new: Column) -> Column:
        return F.when(new.startswith("["), new).when(w == F.upper(w), F.upper(new)).otherwise(F.initcap(new))

    def name(new: Column) -> Column:
        pieces = F.regexp_extract_all(F.substr(e, F.length(title(e)) + 1), F.lit(r"\p{L}[\p{L}\p{M}]*|[^\p{L}]+"), F.lit(0))
        initial = lambda w: F.upper(_pick("abcdefghjklmnprstvz", F.sha2(F.concat_ws("\x1f", F.lit(key), w), 256), F.lit(0)))
        long = lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}]")
        one = lambda every, w, i: F.when(long(w), cased(w, F.get(new, F.size(F.filter(F.slice(every, 1, i), long))))).when(w.rlike(r"^\p{Lu}"), initial(w)).otherwise(w)
        return F.concat(title(e), _let(pieces, lambda every: F.array_join(F.transform(every, lambda w, i: one(every, w, i + 0)), "")))

    def filled(new: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.when(new.startswith("["), new).otherwise(_let(F.regexp_replace(new, r"^\+", ""), lambda n: _each(e, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(n, place(i), F.lit(1))).otherwise(c))))

    def other(k: Column, n: Column) -> Column:
        return F.when(k.isin("card", "phone", "social", "iban"), filled(n)).when(k == "label", F.concat(F.regexp_extract(e, rf"^{HEAD}", 0), n)).when((k == "hex") & (e == F.upper(e)), F.upper(n)).otherwise(n)

    news = F.transform(forms(e), lambda f: surrogate(f, key, code(f)))
    return _let(kind(e), lambda k: _let(news, lambda new: F.when(k == "name", name(new)).otherwise(_let(F.get(new, F.lit(0)), lambda n: other(k, n)))))


# Documents


def _entities(marked: Column) -> Column:
    return F.filter(F.split(marked, _MARK), lambda x, i: i % 2 == 1)


def mark(text: Column) -> Column:
    """The text with each entity between two marks; marks that it has itself are written in another way. In a document with
    names, capitalised words that belong to one of them are entities too."""
    safe = F.when(text.rlike(f"[{_MARK}{_ESCAPE}]"), F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\x04")), F.lit(_MARK), F.lit(_ESCAPE + "\x03"))).otherwise(text)
    plain = F.regexp_replace(safe, ENTITY, f"{_MARK}$0{_MARK}")

    def alone(m: Column, known: Column) -> Column:
        every = F.regexp_replace(m, rf"{_MARK}([^{_MARK}]*+){_MARK}|(?<![\p{{L}}\p{{N}}])(\p{{Lu}}[\p{{L}}\p{{M}}]++)(?![\p{{L}}\p{{N}}])", f"{_MARK}$1$2{_MARK}")
        word = lambda x: x.rlike(rf"^(?!{_PREFIX})\p{{Lu}}[\p{{L}}\p{{M}}]+$") & ~F.array_contains(known, F.lower(x))
        return F.array_join(F.transform(F.split(every, _MARK), lambda x, i: F.when((i % 2 == 0) | word(x), x).otherwise(F.concat(F.lit(_MARK), x, F.lit(_MARK)))), "")

    def named(m: Column) -> Column:
        known = F.array_distinct(F.flatten(F.transform(F.filter(_entities(m), lambda e: kind(e) == "name"), lambda e: F.transform(words(e), F.lower))))
        return F.when(m.contains(_MARK), _let(known, lambda k: F.when(F.size(k) > 0, alone(m, k)).otherwise(m))).otherwise(m)

    return _let(plain, named)


def _plain(marked: Column) -> Column:
    return F.when(marked.contains(_ESCAPE), F.replace(F.replace(marked, F.lit(_ESCAPE + "\x03"), F.lit(_MARK)), F.lit(_ESCAPE + "\x04"), F.lit(_ESCAPE))).otherwise(marked)


def exceptions(mentions: DataFrame, key: str) -> DataFrame:
    """mentions: e. Returns form, code: the forms whose first draw was taken already, or whose bearers' titles tell another
    gender than their own ending."""
    by = F.regexp_extract("e", rf"^({TITLE})", 1)
    told = F.when(by.rlike(rf"^(?:{_FEMALE})\.?.$"), F.lit(1)).when(by.rlike(rf"^(?:{_MALE}|M)\.?.$"), F.lit(2))
    own = F.transform(forms(F.col("e")), lambda f, i: F.struct(f.alias("form"), F.when((i == 0) & (F.size(words(F.col("e"))) > 1), told).alias("told")))
    real = mentions.select(F.explode(own).alias("o")).groupBy("o.form").agg(F.min("o.told").alias("a"), F.max("o.told").alias("b"))
    gender = F.when(F.col("a").isNull(), 0).when(F.col("a") < F.col("b"), 3).when(F.col("a") == _own_gender(F.col("form")), 0).otherwise(F.col("a"))
    real = written(real.select("form", gender.cast("int").alias("gender")), "pii-forms")
    taken, waiting = real.select("form"), real
    out, draw, idle, left_before = None, 0, 0, -1
    new = F.concat(F.substring_index("form", ":", 1), F.lit(":"), surrogate(F.col("form"), key, F.col("code")))
    while True:
        made = waiting.select("form", "gender", (F.col("gender") + draw * _GENDERS).alias("code")).withColumn("new", new)
        first = made.groupBy("new").agg(F.min("form").alias("first"))
        good = made.join(first, "new").where("form = first").select("form", "new", "code").join(taken.withColumnRenamed("form", "new"), "new", "left_anti")
        good = written(good, "pii-drawn")
        some = good.where("code <> 0").select("form", "code")
        out = some if out is None else out.union(some)
        before, waiting = waiting, written(waiting.join(good.select("form"), "form", "left_anti"), "pii-left")
        if draw:
            discard(before)
        n = waiting.count()
        if not n:
            return out
        idle = idle + 1 if n == left_before else 0
        if idle >= 3 and draw >= 8:  # the format's space is full
            return out.union(waiting.select("form", F.lit(-_GENDERS).alias("code")))
        taken, draw, left_before = taken.union(good.select(F.col("new").alias("form"))), draw + 1, n


def replace(docs: DataFrame, key: str, most_broadcast: int = 10_000) -> DataFrame:
    """docs: text and more. Returns docs with every entity in text replaced, and n_entities.

    key: who knows it can repeat the replacements; keep it secret. most_broadcast: up to so many exceptions (about 100 bytes
    each) go to all tasks as one constant, in buckets; more are joined by the text they occur in.
    """
    names = docs.columns
    numbered = docs.select(*((mark(docs[f"`{n}`"].cast("string")) if n == "text" else docs[f"`{n}`"]).alias(f"c{i}") for i, n in enumerate(names)))
    m = f"c{names.index('text')}"
    numbered = written(numbered, "pii-marked")
    special = exceptions(numbered.where(F.col(m).contains(_MARK)).select(F.explode(_entities(F.col(m))).alias("e")), key)
    n = special.limit(most_broadcast + 1).count()
    if n == 0:
        code = lambda f: F.lit(0)
    elif n <= most_broadcast:
        buckets = [{} for _ in range(1024)]
        for r in special.select("form", "code", F.pmod(F.xxhash64("form"), F.lit(len(buckets))).alias("b")).collect():
            buckets[r["b"]][r["form"]] = r["code"]
        constant = F.from_json(F.lit(json.dumps(buckets)), "array<map<string, int>>")  # folded once
        code = lambda f: F.coalesce(F.element_at(F.get(constant, F.pmod(F.xxhash64(f), F.lit(len(buckets)))), f), F.lit(0))
    else:
        own = numbered.where(F.col(m).contains(_MARK)).select(F.sha2(m, 256).alias("d"), F.explode(F.flatten(F.transform(_entities(F.col(m)), forms))).alias("form")).distinct()
        own = own.join(special, "form").groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("form", "code"))).alias("x"))
        numbered = numbered.withColumn("d", F.when(F.col(m).contains(_MARK), F.sha2(m, 256))).join(own, "d", "left")
        code = lambda f: F.coalesce(F.element_at("x", f), F.lit(0))
    joined = F.array_join(F.transform(F.split(m, _MARK), lambda x, i: F.when(i % 2 == 0, x).otherwise(written_as(x, key, code))), "")
    text = _plain(F.when(F.col(m).contains(_MARK), joined).otherwise(F.col(m)))
    count = F.floor((F.size(F.split(m, _MARK)) - 1) / 2)
    keep = [(text if n == "text" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names) if n != "n_entities"]
    return numbered.select(*keep, F.when(F.col(m).isNull(), 0).otherwise(count).cast("long").alias("n_entities"))
