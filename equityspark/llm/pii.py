"""PII surrogates in built-in SQL functions only.

One pattern finds e-mail addresses, phone numbers, card and account numbers, social
security numbers, IPv4 addresses and titled names. Mentions are reduced to entities (the
same number in another layout, an address in other letter case are one entity). Every
entity of the corpus gets one keyed replacement of its type: digits stay digits in the
mention's own layout, a card number that passes its check digit still does, a name keeps
title, gender and script, letters keep their case. Each part of a name is an entity (with
the gender of the title), so that a full mention and a short one agree. Replacements are drawn again, with a
counter, until they are distinct among themselves and from every entity of the corpus, so
different people stay different and one person stays one. What is still open after
``SAME_FORMAT`` draws gets one more digit, letter, syllable or octet with each further draw,
so that the values always outgrow the entities.

Only documents with a mention take part in the joins; the others pass through. Texts are
keyed by a digest and each text's mentions are looked up once, so a text that a third of
all rows repeat is looked up once.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.llm import common

# Titles by gender, and syllables for invented names by script.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа", "κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Mx", "д-р", "проф", "δρ"]
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре".split(),
    "greek": "βα βε βι βο γα γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε".split(),
}
SAME_FORMAT = 12
ENDINGS = {"latin": ("n", "a", "r"), "cyrillic": ("н", "на", "р"), "greek": ("ς", "α", "ν")}  # male, female, neither

LABELS = r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})|(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@" + LABELS
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])(?!\.\d)"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w)(?!\.\d)"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])(?!\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
TITLE = "(?:" + "|".join([*MALE, *FEMALE, *NEUTRAL]) + r")\.? "
TAIL = r"(?:['’](?![sS](?!\p{L}))|-)\p{L}[\p{L}\p{M}]*+"  # an apostrophe or hyphen inside a name, no possessive
WORD = r"(?:[dDlL]['’])?\p{Lu}(?:[\p{L}\p{M}]++(?:" + TAIL + ")*+|(?:" + TAIL + ")++)"
UNIT = r"(?:(?:\p{Lu}\.)++ )*+" + WORD  # a part with the initials before it
NAME = r"(?<!\p{L})" + TITLE + "(?:" + TITLE + "){0,4}(?:" + UNIT + r"|(?:\p{Lu}\.)*+\p{Lu}(?!\p{L}))(?: " + UNIT + ")*+"
KINDS = {"email": EMAIL, "iban": IBAN, "ssn": SSN, "ipv4": IPV4, "phone": PHONE, "card": CARD, "name": NAME}
PATTERN = "|".join(KINDS.values())
# a capitalised word as it may stand for a name met before, without a possessive ending
LONE = r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]++(?:['’](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+|(?<![\p{L}\p{M}])\p{Lu}(?:['’](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*+)++"
HINT = r"[@\d]|" + TITLE + r"(?:[dDlL]['’])?\p{Lu}"  # a text without this has no mention


def _kind(m: Column) -> Column:
    case = None
    for name, p in KINDS.items():
        hit = F.regexp_extract(m, f"^(?:{_plain(p)})$", 0) != ""
        case = F.when(hit, F.lit(name)) if case is None else case.when(hit, F.lit(name))
    return case.otherwise(F.lit("card"))


def _plain(p: str) -> str:
    """The pattern without its leading context, for a mention taken out of its text."""
    return p[p.index(")", p.index("(?<!")) + 1:] if p.startswith("(?<!") else p


def _title(m: Column) -> Column:
    return F.regexp_extract(m, "^" + TITLE + "(?:" + TITLE + r"){0,4}(?=(?:[dDlL]['’])?\p{Lu})", 0)


def _norms(kind: Column, m: Column) -> Column:
    """What makes two mentions one entity; a name has one for each of its parts."""
    title = _title(m)
    of = lambda titles: title.rlike(r"(?:^| )(?:" + "|".join(titles) + r")\.? ")
    gender = F.when(of(FEMALE), F.lit("f:")).when(of(MALE), F.lit("m:")).otherwise(F.lit("n:"))
    bare = F.lower(F.translate(F.substr(m, F.length(title) + 1, F.length(m)), "’", "'"))
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(kind == "email", F.array(F.lower(m))).when(kind == "ipv4", F.array(m))
        .when(kind == "name", F.transform(F.split(bare, "[ -]", -1), lambda part: F.concat(gender, part)))
        .when(kind == "iban", F.array(F.regexp_replace(m, " ", ""))).otherwise(F.array(digits)))


def _nibbles(h: Column, i: Column) -> Column:
    """A pseudo-random number below 65,536 from place ``i`` of a 64-digit hex digest."""
    return F.conv(F.substr(h, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")


def _digits(norm: Column, h: Column, keep: int) -> Column:
    """As many digits, the first ``keep`` unchanged, none of the drawn ones leading with zero."""
    draw = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.when(i <= keep, F.substr(norm, i, F.lit(1))).otherwise(
        F.when(i == keep + 1, F.pmod(_nibbles(h, i), F.lit(8)) + 2).otherwise(F.pmod(_nibbles(h, i), F.lit(10))).cast("string")))
    return F.array_join(draw, "")


def _luhn(body: Column) -> Column:
    """Check digit behind ``body``."""
    n = F.length(body)
    value = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when(F.pmod(n - i, F.lit(2)) == 0, F.expr("0") + _double(F.substr(body, i, F.lit(1)).cast("int"))).otherwise(F.substr(body, i, F.lit(1)).cast("int")))
    return F.pmod(10 - F.pmod(value, F.lit(10)), F.lit(10)).cast("string")


def _double(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _card(norm: Column, h: Column, wider: int = 0) -> Column:
    body, own = F.substr(norm, F.lit(1), F.length(norm) - 1), F.substr(norm, F.length(norm), F.lit(1))
    drawn = _digits(_longer(norm, wider), h, 1)
    fixed = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    return F.when(_luhn(body) == own, F.concat(fixed, _luhn(fixed))).otherwise(drawn)


def _longer(norm: Column, wider: int) -> Column:
    return F.concat(norm, F.lit("0" * wider)) if wider else norm


def _letters(norm: Column, h: Column) -> Column:
    """Letters to letters and digits to digits, place by place; other characters stay, or become letters if there is nothing else."""
    bare = ~norm.rlike("[A-Za-z0-9]")
    draw = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: (
        F.when(bare | F.substr(norm, i, F.lit(1)).rlike("[a-z]"), F.substr(F.lit(common.LOWER), F.pmod(_nibbles(h, i), F.lit(26)) + 1, F.lit(1)))
        .when(F.substr(norm, i, F.lit(1)).rlike("[A-Z]"), F.substr(F.lit(common.UPPER), F.pmod(_nibbles(h, i), F.lit(26)) + 1, F.lit(1)))
        .when(F.substr(norm, i, F.lit(1)).rlike("[0-9]"), F.pmod(_nibbles(h, i), F.lit(10)).cast("string"))
        .otherwise(F.substr(norm, i, F.lit(1)))))
    return F.array_join(draw, "")


def _email(norm: Column, h: Column) -> Column:
    """Local part and first domain label drawn, the rest of the domain kept."""
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    label = F.substring_index(domain, ".", 1)
    return F.concat(_letters(local, h), F.lit("@"), _letters(label, F.reverse(h)), F.substr(domain, F.length(label) + 1, F.length(domain)))


def _ipv4(h: Column) -> Column:
    part = lambda i, m, a: (F.pmod(_nibbles(h, F.lit(i)), F.lit(m)) + a).cast("string")
    return F.concat_ws(".", part(1, 223, 1), part(5, 256, 0), part(9, 256, 0), part(13, 254, 1))


def _name(norm: Column, h: Column, wider: int = 0) -> Column:
    """Gender, then as many drawn names of the same script as the entity has."""
    gender, names = F.substr(norm, F.lit(1), F.lit(1)), F.split(F.substr(norm, F.lit(3), F.length(norm)), " ")
    script = F.when(norm.rlike(r":.*\p{IsCyrillic}"), F.lit("cyrillic")).when(norm.rlike(r":.*\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))

    def drawn(s: str) -> Column:
        bank = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        end = F.when(gender == "f", F.lit(ENDINGS[s][1])).when(gender == "m", F.lit(ENDINGS[s][0])).otherwise(F.lit(ENDINGS[s][2]))
        one = lambda w, i: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 + wider)), lambda k: F.get(bank, F.pmod(_nibbles(h, i * 5 + k), F.lit(32)))), ""), end)
        return F.array_join(F.transform(names, one), " ")

    value = F.when(script == "cyrillic", drawn("cyrillic")).when(script == "greek", drawn("greek")).otherwise(drawn("latin"))
    return F.concat(gender, F.lit(":"), value)


def _draw(kind: Column, norm: Column, key: str, round_: int) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(round_)), 256)
    wider = max(0, round_ + 1 - SAME_FORMAT)
    mail, ip = _email(norm, h), _ipv4(h)
    if wider:
        more = F.sequence(F.lit(1), F.lit(wider))
        mail = F.concat(_letters(F.lit("a" * wider), F.sha2(h, 256)), mail)
        ip = F.concat_ws(".", ip, F.array_join(F.transform(more, lambda i: F.pmod(_nibbles(F.sha2(h, 256), i), F.lit(256)).cast("string")), "."))
    long_ = _longer(norm, wider)
    return (
        F.when(kind == "email", mail).when(kind == "ipv4", ip).when(kind == "name", _name(norm, h, wider))
        .when(kind == "card", _card(norm, h, wider)).when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), _letters(F.substr(long_, F.lit(3), F.length(long_)), h)))
        .when(kind == "phone", _digits(long_, h, 1)).otherwise(_digits(long_, h, 0)))


def surrogates(entities: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """One distinct replacement for each (kind, norm); none equals an entity of the corpus.

    Of several entities that draw the same replacement the first by ``norm`` keeps it, the
    others draw again, in a wider format after ``SAME_FORMAT`` draws, until none is left. With
    ``rounds`` an error is raised instead if some are left after that many.
    """
    spark = entities.sparkSession
    # dealt to all tasks by key: a small table would be drawn for in one
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = common.written(entities.select("kind", "norm").distinct().repartition(parts, "kind", "norm"), "entities")
    folders: list[str] = []
    open_, done = known, None
    for r in count() if rounds is None else range(rounds):
        tried = open_.withColumn("surrogate", _draw(F.col("kind"), F.col("norm"), key, r))
        free = tried.join(known.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate")
        folders.append(common.scratch(spark, "surrogates"))
        won.write.parquet(folders[-1])
        done = spark.read.schema(won.schema).parquet(*folders)
        open_ = known.join(done, ["kind", "norm"], "left_anti")
        if not open_.limit(1).count():
            return done
    raise RuntimeError("no distinct replacement left for some entities")


def _render(kind: Column, mention: Column, surrogate: Column, parts: Column | None = None) -> Column:
    """The replacement in the mention's layout and letter case; what a wider one has more comes last."""
    chars = F.split(mention, "")
    place = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("[0-9]") | ((kind == "iban") & c.rlike("[A-Z]")),
                            F.struct(F.concat(a["out"], F.substr(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))))
    place = F.concat(place["out"], F.substr(surrogate, place["at"], F.length(surrogate)))
    mail = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    title = _title(mention)
    rest = F.substr(mention, F.length(title) + 1, F.length(mention))
    loud = (rest == F.upper(rest)) & rest.rlike(r"\p{L}{2}")
    one = lambda x: F.substr(x, F.lit(3), F.length(x))
    names = F.transform(F.array(surrogate) if parts is None else parts, lambda x: F.when(loud, F.upper(one(x))).otherwise(F.initcap(one(x))))
    between = F.regexp_extract_all(rest, F.lit("[ -]"), F.lit(0))
    name = F.concat(title, F.array_join(F.zip_with(names, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    return F.when(kind == "email", mail).when(kind == "ipv4", surrogate).when(kind == "name", name).otherwise(place)


def _gendered(lines: DataFrame) -> DataFrame:
    """A neutral title takes the gender that the same name part has elsewhere in the text, if it has one."""
    bare, gender = F.substr("norm", F.lit(3)), F.substr("norm", F.lit(1), F.lit(1))
    # the parts of one text
    w = Window.partitionBy("digest", "kind", F.when(F.col("kind") == "name", bare).otherwise(F.col("norm")))
    both = lines.withColumns({"_m": F.max(gender == "m").over(w), "_f": F.max(gender == "f").over(w)})
    own = F.when(F.col("_m") & ~F.col("_f"), F.lit("m")).when(F.col("_f") & ~F.col("_m"), F.lit("f")).otherwise(F.lit("n"))
    norm = F.when((F.col("kind") == "name") & (gender == "n"), F.concat(own, F.lit(":"), bare)).otherwise(F.col("norm"))
    return both.withColumn("norm", norm).drop("_m", "_f")


def _bound(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``: worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lone(piece: Column, names: Column) -> Column:
    """(text, hits) of a piece between mentions, its lone names replaced by what the text's name parts became."""
    become = lambda w: F.element_at(names, F.lower(F.translate(w, "’", "'")))
    shown = lambda w, n: F.when(n.isNull(), w).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(n)).otherwise(F.initcap(n))

    def rendered(words: Column, new: Column) -> Column:
        found = F.size(F.filter(new, lambda n: n.isNotNull()))
        between = F.zip_with(F.split(piece, LONE, -1), F.zip_with(words, new, shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.struct(F.when(found > 0, F.array_join(between, "")).otherwise(piece).alias("text"), found.alias("hits"))

    words = F.regexp_extract_all(piece, F.lit(LONE), F.lit(0))
    return _bound(words, lambda w: _bound(F.transform(w, become), lambda n: rendered(w, n)))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text replaced and ``n_pii`` (mentions replaced) added.

    In a text with titled names, every capitalised word that equals one of their parts (of
    two letters or more) is a mention too and becomes what the part became there first.
    Null texts stay null, empty ones empty, both with 0 mentions. Repeated rows and texts
    get the same replacements. A replacement depends on ``key``, the entity and, only after
    a collision, on the other entities of the corpus. A column named ``n_pii`` is replaced,
    all others are kept.
    """
    df = docs.drop(*[c for c in docs.columns if c.lower() == "n_pii"])
    kept = df.columns
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    mentions = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    marked = row.withColumn("mentions", F.coalesce(mentions, F.array().cast("array<string>")))
    hit = F.size("mentions") > 0
    some = marked.where(hit).withColumn("digest", F.sha2("text", 256))
    lines = some.select("digest", F.posexplode("mentions").alias("pos", "mention")).groupBy("digest", "pos").agg(F.first("mention").alias("mention"))
    lines = lines.withColumn("kind", _kind(F.col("mention")))
    lines = lines.select("digest", "pos", "mention", "kind", F.posexplode(_norms(F.col("kind"), F.col("mention"))).alias("part", "norm"))
    lines = common.written(_gendered(lines), "mentions")
    drawn = lines.join(surrogates(lines, key), ["kind", "norm"])
    known = drawn.groupBy("digest", "pos").agg(
        F.first("kind").alias("kind"), F.first("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("part", "surrogate")))["surrogate"].alias("parts"))
    known = known.withColumn("new", _render(F.col("kind"), F.col("mention"), F.col("parts")[0], F.col("parts")))
    per_text = known.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pos", "new")))["new"].alias("new"))
    bare = drawn.where("kind = 'name'").select("digest", "pos", "part", F.substr("norm", F.lit(3)).alias("bare"), F.substr("surrogate", F.lit(3)).alias("becomes")).where("length(bare) > 1")
    bare = bare.groupBy("digest", "bare").agg(F.min(F.struct("pos", "part", "becomes"))["becomes"].alias("becomes"))
    names = bare.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("bare", "becomes"))).alias("names"))
    pieces = F.split("text", PATTERN, -1)
    plain = F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(0).alias("hits")))
    done = F.when(F.col("names").isNull(), plain).otherwise(F.transform(pieces, lambda p: _lone(p, F.col("names"))))
    changed = some.join(per_text.join(names, "digest", "left"), "digest").withColumn("done", done)
    fresh = F.array_join(F.zip_with(F.col("done.text"), F.col("new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n = F.size("mentions") + F.aggregate("done.hits", F.lit(0), lambda a, x: a + x)
    changed = changed.select("row", fresh.alias("text"), n.cast("long").alias("n_pii"))
    out = marked.where(~hit).select("row", "text", F.lit(0).cast("long").alias("n_pii")).unionByName(changed)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept], "n_pii")
