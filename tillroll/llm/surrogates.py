"""Surrogate generation for personal data, with built-in functions only.

1. Mentions are found by one pattern; each has a kind and a canonical form
   (lower-case address, bare digits, ...), so different spellings of one entity
   meet (coreference).
2. The distinct entities get surrogates from a keyed hash that fill the
   canonical form class by class: digits by digits, letters by letters of the
   same script, with valid check digits, kept country codes, kept private or
   public network range, and names of the same gender and script. An address's
   domain depends on the domain only, a name's words on the words only, so parts
   stay coreferent too.
3. Collision checks over the whole corpus: a surrogate must differ from every
   other surrogate and from every real entity of its kind; losers draw again.
4. The mentions meet the surrogates in a join, are rendered in the mention's
   own format (separators, case) and put back between the text's other parts.

Texts without a digit, an ``@``, a secret's keyword, a title or a key or address of letters are passed by;
only the others are ever shuffled. The key is a parameter and is needed to
repeat the surrogates.

Defined results: a null text stays null, an empty text empty, both with no
mention; ids may be null or repeated (rows are told apart by id and text hash,
equal rows get equal results); other columns pass through, one named
``n_replaced`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, let, scratch, small, stored

MAX_ROUNDS = 60

# Patterns of the kinds, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_WORD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Господин|Г-н|Κύριος"
_TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа|Г-жа|Κυρία"
_TITLES_N = "Dr|Prof|Professor"
_COUNTRY = r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?"
_BEFORE = r"(?<![\w.,+/-])(?<!\d )"
_BEHIND = r"(?![\w-])(?![.,/]\d)"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "aws_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": _SECRET_WORD + r"[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_.-]{8,}",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ipv6": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
             # shortened by ::, with a digit somewhere, which names joined by :: in code seldom have
             r"|(?<![\w:.])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
    "phone": (r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
              r"|(?<![\w+])\+\d{8,15}(?!\w)"
              # pairs after a country code or the trunk zero; three digits and pairs
              rf"|{_BEFORE}(?:{_COUNTRY}\d|0\d)(?:[ .-]\d{{2}}){{4}}{_BEHIND}"
              rf"|{_BEFORE}(?:{_COUNTRY})?\d{{3}}(?:[ .-]\d{{2}}){{3}}{_BEHIND}"
              # area and subscriber; groups after a country code
              rf"|{_BEFORE}(?:0\d{{1,4}}[ /-]\d{{5,8}}|{_COUNTRY}\(?\d{{1,4}}\)?[ ./-]\d{{4,8}})(?:-\d{{1,4}})?{_BEHIND}"
              rf"|{_BEFORE}{_COUNTRY}\d{{1,4}}(?:[ ./-]\d{{2,4}}){{2,3}}{_BEHIND}"),
    "name": (rf"(?<!\p{{L}})(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? \p{{Lu}}[\p{{L}}'-]+"
             r"(?: \p{Lu}[\p{L}'-]+)?"),
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every mention holds at least.
HINT = rf"[\d@]|AKIA[A-Z]{{16}}|(?:[A-Fa-f]{{2}}[:-]){{5}}|(?:[A-Fa-f]{{1,4}}:){{7}}|{_SECRET_WORD}|(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? \p{{Lu}}"

# Building blocks of surrogate names, per script, and the endings of each gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne no pa re ro sa se so ta te to",
    "cyrillic": "ба бе бо да де до ва ве га го ка ке ла ле ли ло ма ме ми мо на не но па ре ро са се со та те то",
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λι λο μα με μι μο να νε νο πα ρε ρο σα σε σο τα τε το",
}
ENDINGS = {
    "latin": {"m": "n rd s", "f": "na ra lia", "n": "l x y", "family": "man son ler ton"},
    "cyrillic": {"m": "н р с", "f": "на ра лия", "n": "л й т", "family": "нов рин шев ко"},
    "greek": {"m": "ς ν ρος", "f": "να ρα λια", "n": "λι ξι τι", "family": "δης ου πουλος κης"},
}
FIRST_TITLE = {"m": _TITLES_M, "f": _TITLES_F}


def kind_of(mention: Column) -> Column:
    """Kind of a mention: the first whose pattern is the whole mention."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(KINDS.items()):
        out = F.when(F.rlike(mention, F.lit(f"^(?:{p})$")), F.lit(kind)).otherwise(out)
    gender = F.when(F.rlike(mention, F.lit(f"^(?:{_TITLES_M})\\b")), "_m").when(
        F.rlike(mention, F.lit(f"^(?:{_TITLES_F})\\b")), "_f").otherwise("_n")
    return F.when(out == "name", F.concat(out, gender)).otherwise(out)


def _secret_head(mention: Column) -> Column:
    return F.regexp_extract(mention, "^(" + _SECRET_WORD + r"[\"']? ?[=:] ?[\"']?)", 1)


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^((?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? )", 1)


def _after(text: Column, head: Column) -> Column:
    return F.substr(text, F.length(head) + 1)


def canonical(kind: Column, mention: Column) -> Column:
    """The form that all spellings of an entity share."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (F.when(kind.isin("phone", "card", "ssn"), digits)
            .when(kind == "email", F.lower(mention))
            .when(kind.isin("mac", "ipv6"), F.lower(mention))
            .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
            .when(kind == "secret", _after(mention, _secret_head(mention)))
            .when(F.startswith(kind, F.lit("name")), F.lower(_after(mention, _title(mention))))
            .otherwise(mention))


def mentions(text: Column) -> Column:
    """Array of (kind, mention, canon) in text order; empty for a null text."""
    t = F.coalesce(text, F.lit(""))
    found = F.when(F.rlike(t, F.lit(HINT)), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    return F.transform(found, lambda m: let(kind_of(m), lambda k: F.struct(
        k.alias("kind"), m.alias("mention"), canonical(k, m).alias("canon"))))


def _hash(key: str, *parts: Column) -> Column:
    """64 hex digits of key and parts."""
    sep = F.lit("\x1f")
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts], sep), 256)


def _number(digest: Column, i, width: int = 4) -> Column:
    """The ``i``-th group of hex digits of a digest as a number."""
    at = (i * width + 1) if isinstance(i, int) else i * width + F.lit(1)
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(width)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substr(F.lit(chars), F.pmod(n, F.lit(len(chars))) + 1, F.lit(1))


def fill(key: str, form: Column, salt: Column, hexa: bool = False) -> Column:
    """Every digit and letter of ``form`` replaced by a keyed one of its class; a digit other
    than zero stays one, other characters stay."""
    def one(digests):
        def char(c, i):
            n = _number(F.get(digests, F.floor(i / 16).cast("int")), i % 16)
            if hexa:
                return F.when(F.rlike(c, F.lit("[0-9a-f]")), _pick("0123456789abcdef", n)).otherwise(c)
            return (F.when(c == "0", _pick("0123456789", n))
                    .when(F.rlike(c, F.lit("[1-9]")), _pick("123456789", n))
                    .when(F.rlike(c, F.lit("[a-z]")), _pick("abcdefghijklmnopqrstuvwxyz", n))
                    .when(F.rlike(c, F.lit("[A-Z]")), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c))
        return F.array_join(F.transform(F.split(form, ""), char), "")

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(form) / 16).cast("int")),
                         lambda b: _hash(key, form, salt, b))
    return let(blocks, one)


def _luhn(body: Column) -> Column:
    """The check digit of a card number without it."""
    def term(c, i):
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), term), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _iban(country: Column, account: Column) -> Column:
    """Country, check digits and account."""
    values = F.transform(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: F.when(
        F.rlike(c, F.lit(r"\d")), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.pmod(
        a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
    return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)


def _name_word(key: str, word: Column, part: str, attempt: Column) -> Column:
    """A name of the word's script, with the ending of its gender or of family names."""
    def build(script):
        syllables, ends = SYLLABLES[script].split(), ENDINGS[script][part].split()

        def make(h):
            n = F.lit(2) + F.least(attempt, F.lit(8))  # later draws have more room
            body = F.transform(F.sequence(F.lit(0), n), lambda i: F.get(
                F.array(*[F.lit(x) for x in syllables]), F.pmod(_number(h, i), F.lit(len(syllables)))))
            end = F.get(F.array(*[F.lit(x) for x in ends]), F.pmod(_number(h, 15), F.lit(len(ends))))
            return F.concat(F.array_join(body, ""), end)

        return let(_hash(key, word, F.lit(part), attempt), make)

    return (F.when(F.rlike(word, F.lit(r"^\p{IsCyrillic}")), build("cyrillic"))
            .when(F.rlike(word, F.lit(r"^\p{IsGreek}")), build("greek")).otherwise(build("latin")))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical form of the surrogate of an entity, at the given draw."""
    filled = fill(key, canon, attempt)
    words = F.split(canon, " ")
    none = F.lit(0)

    def email():
        domain = F.substring_index(canon, "@", -1)
        tld = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld))
        local = F.substring_index(fill(key, canon, attempt), "@", 1)
        return F.concat(local, F.lit("@"), fill(key, host, none), tld)

    def phone():  # the country code of a long number stays
        n = F.greatest(F.length(canon) - 10, F.lit(0))
        return F.concat(F.substring(canon, F.lit(1), n), fill(key, F.substr(canon, n + 1), attempt))

    def ip():
        h = _hash(key, canon, attempt)
        a, b = F.substring_index(canon, ".", 1), F.substring_index(canon, ".", 2)
        tail = [F.pmod(_number(h, i), F.lit(256)).cast("string") for i in (1, 2)]
        last = (F.pmod(_number(h, 3), F.lit(254)) + 1).cast("string")
        second = F.split(b, r"\.")
        in_172 = (a == "172") & F.get(second, F.lit(1)).cast("int").between(16, 31)
        head = (F.when(b == "192.168", b).when(in_172, F.concat(F.lit("172."), (
            F.pmod(_number(h, 4), F.lit(16)) + 16).cast("string")))
            .when(a.isin("10", "127"), F.concat_ws(".", a, tail[1]))
            .otherwise(F.concat_ws(".", (F.pmod(_number(h, 4), F.lit(88)) + 11).cast("string"), tail[1])))
        return F.concat_ws(".", head, tail[0], last)

    def card():
        body = F.substring(filled, F.lit(2), F.length(canon) - 2)
        body = F.concat(F.substring(canon, 1, 1), body)
        return F.concat(body, _luhn(body))

    def name(gender):
        first, last = F.get(words, none), F.get(words, F.lit(1))
        return F.when(last.isNull(), _name_word(key, first, "family", attempt)).otherwise(F.concat_ws(
            " ", _name_word(key, first, gender, attempt), _name_word(key, last, "family", none)))

    hexa = fill(key, canon, attempt, hexa=True)
    return (F.when(kind == "email", email()).when(kind == "phone", phone()).when(kind == "ip", ip())
            .when(kind == "card", card())
            .when(kind == "aws_key", F.concat(F.lit("AKIA"), F.substr(filled, F.lit(5))))
            .when(kind == "iban", _iban(F.substring(canon, 1, 2), F.substr(filled, F.lit(5))))
            .when(kind.isin("mac", "ipv6"), hexa)
            .when((kind == "secret") & F.rlike(canon, F.lit("^[0-9a-f]+$")), hexa)
            .when(kind == "name_m", name("m")).when(kind == "name_f", name("f"))
            .when(kind == "name_n", name("n")).otherwise(filled))


def render(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the format of the mention: its separators, case, title or keyword."""
    chars = F.split(mention, "")
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(
        F.rlike(c, F.lit(r"\d")), F.substr(made, F.length(F.regexp_replace(
            F.substr(mention, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(chars, lambda c, i: let(
        F.substr(made, i + 1, F.lit(1)), lambda s: F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(s))
        .otherwise(s))), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(
        made, F.length(F.replace(F.substr(mention, F.lit(1), i + 1), F.lit(" "), F.lit(""))),
        F.lit(1)))), "")
    title = _title(mention)
    shout = F.rlike(_after(mention, title), F.lit(r"^[\p{Lu} '-]+$"))
    return (F.when(kind.isin("phone", "card", "ssn"), digits)
            .when(kind.isin("email", "mac", "ipv6"), cased).when(kind == "iban", spaced)
            .when(kind == "secret", F.concat(_secret_head(mention), made))
            .when(F.startswith(kind, F.lit("name")), F.concat(title, F.when(
                shout, F.upper(made)).otherwise(F.initcap(made)))).otherwise(made))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) for a stored table of distinct (kind, canon): distinct surrogates
    that are no real entity. Losers of a draw draw again."""
    base = scratch(entities.sparkSession)
    pending, done = entities, []
    real = entities.select("kind", F.col("canon").alias("made"))
    for i in range(MAX_ROUNDS):
        drawn = pending.withColumn("made", surrogate(key, F.col("kind"), F.col("canon"), F.lit(i)))
        drawn = reduce(lambda d, taken: d.join(taken, ["kind", "made"], "left_anti"),
                       [real, *[d.select("kind", "made") for d in done]], drawn)
        won = drawn.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        done.append(stored(won.select("kind", "canon", "made"), f"{base}/won-{i}"))
        pending = stored(pending.join(done[-1], ["kind", "canon"], "left_anti"), f"{base}/left-{i}")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"entities without a surrogate of their own after {MAX_ROUNDS} draws")


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_replaced``."""
    base = scratch(docs.sparkSession)
    (doc,) = fresh(docs, "doc")
    t = F.col(f"`{text}`")
    hint = F.coalesce(F.rlike(t, F.lit(HINT)), F.lit(False))
    some = docs.filter(hint).withColumn(doc, F.struct(
        F.col(f"`{doc_id}`").alias("id"), F.md5(t).alias("h")))
    found = stored(some.select(F.col(doc).alias("doc"), F.posexplode(mentions(t)).alias("pos", "m"))
                   .select("doc", "pos", "m.*"), f"{base}/mentions")
    entities = stored(found.select("kind", "canon").distinct(), f"{base}/entities")
    made = small(stored(assign(entities, key), f"{base}/made"))
    rendered = found.join(made, ["kind", "canon"]).select("doc", F.struct("pos", render(
        F.col("kind"), F.col("mention"), F.col("made")).alias("s")).alias("p"))
    by_doc = rendered.groupBy("doc").agg(F.sort_array(F.collect_set("p")).alias("p")).select(
        "doc", F.col("p.s").alias("s"))

    out = [c for c in docs.columns if c.lower() != "n_replaced"]
    d = some.alias("d").join(by_doc.alias("m"), F.col(f"d.{doc}") == F.col("m.doc"), "left")
    body = F.col(f"d.`{text}`")
    parts = F.split(body, PATTERN)
    put = F.array_join(F.zip_with(parts, F.col("m.s"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(F.col("m.s").isNull(), body).otherwise(put)
    count = F.coalesce(F.size("m.s"), F.lit(0)).cast("long")
    changed = d.select(*[(new.alias(c) if c == text else F.col(f"d.`{c}`")) for c in out],
                       count.alias("n_replaced"))
    return docs.filter(~hint).select(*[F.col(f"`{c}`") for c in out],
                                     F.lit(0).cast("long").alias("n_replaced")).unionByName(changed)
