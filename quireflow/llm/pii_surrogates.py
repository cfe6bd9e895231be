"""PII: keyed, type-consistent surrogates, in DataFrame functions only.

A detected entity becomes a list of parts; a part has literal text before it, a kind, and a
canonical form by which equal things are recognised across spellings and documents. Each
distinct (class, canonical form) gets one surrogate from a keyed hash; those that collide with
another's surrogate, or with a real value, try again with the next attempt number. A surrogate
is then written in the format of the spelling at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.store import dropped, written

#: A label has 63 signs and a name 127 labels at most. Java matches groups by recursion, so a group without a bound could end the process.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])"
SECRET = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?:ghp_|gho_|sk-|xoxb-)[A-Za-z0-9\-]{20,}|(?=[aApPsStT])(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|secret[_\-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9/+_\-]{8,}"
HEX = r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
#: Digits in groups, 13 or more together and no group of over 19, with the sign after them; ``_inside`` finds what they hold.
#: A longer run is taken in stretches of 400 groups, which keeps the work linear; an entity across a seam is not seen.
NUMBERS = r"(?:(?<![\d.\-])|\G)(?=\d(?:[ .\-]?\d){12})(?!\d{20})\d++(?![A-Za-z0-9._%+\-]{0,64}@)(?:[ .\-]\d++(?![A-Za-z0-9._%+\-]{0,64}@)){0,399}+[\w\-]?"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)"
PLAIN_PHONE = r"(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
MALE = r"Mr|MR|Herr|Monsieur|Señor|Signor|г-н|Господин"
FEMALE = r"Mrs|MRS|MS|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Signora|г-жа|Госпожа"
NEUTRAL = r"Mx|Dr|Prof"
NAME_WORD = r"\p{Lu}[\p{L}'’\-]+"
NAME = rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE}|{NEUTRAL})\.? {NAME_WORD}(?: {NAME_WORD})?"

#: In order: where two could start at one place, the first is taken. An entity starts a word,
#: and the first look at its first sign spares most words the alternatives.
ENTITY = rf"(?<![A-Za-z0-9])(?:(?=[A-Za-z0-9])(?:{EMAIL}|{SECRET}|{HEX})|(?=\d)(?:{IP}|{NUMBERS}|{SSN}|{PLAIN_PHONE})|{PHONE}|(?=[\p{{Lu}}г])(?:{NAME}))"

GIVEN = {
    ("f", "latin"): "Anna Clara Diana Elena Fiona Greta Helena Irene Julia Karin Laura Maria Nadia Olivia Paula Rosa Sofia Teresa Ursula Vera",
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Ralf Simon Thomas Victor",
    ("n", "latin"): "Alex Andrea Ariel Ashley Blair Casey Chris Dana Jamie Jordan Kim Lee Morgan Nico Quinn Robin Sam Sasha Taylor Toni",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия Яна",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Фёдор Юрий Яков",
    ("n", "cyrillic"): "Женя Саша Валя Слава Паша Рита Шура Тоня Вика Люся Ника Мика Витя Гена Дима Кира Лёва Миша Надя Юля",
}
FAMILY = {
    "latin": ("Al Bar Cal Dor El Fan Gar Hol In Jar Kel Lor Mar Nor Ol Per Quil Ras Sel Tor Ul Ver Wal Yar", "ben by den der fall ford gate ham ing ker land ley man mer mont ner ow rick son stad ston ton wick worth"),
    "cyrillic": ("Бар Вол Гор Дол Ер Жар Зим Ив Кар Лав Мор Ник Ор Пет Рог Сав Тар Ур Фом Хар Чер Шах Юр Яр", "анов ехин енко ин лев мин нев ов рин син тин ушин хин чев шин щин язов янин ухин окин арин евин икин итов"),
}
#: Letters by class: what a letter of that class is replaced with.
ALPHABETS = (
    (r"\p{IsLatin}&&\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"\p{IsLatin}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{IsCyrillic}&&\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"\p{IsGreek}&&\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHan}", "安白成大方高国海和华家江金林明宁平清山石水天文新星雨玉云志中"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにのはひふまみもやゆよらりる"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニノハヒフマミモヤユヨラリル"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
    (r"\p{IsArabic}&&\p{L}", "ابتجحدرزسشصطعفقكلمنهوي"),
    (r"\p{IsHebrew}&&\p{L}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{L}", "x"),
    (r"0-9", "0123456789"),
)


#: Rounds of collision checks before the space of a format counts as full.
ATTEMPTS = 100


def _seed(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def _pick(values: list[str] | str, n: Column) -> Column:
    """One of ``values``, by ``n``."""
    if isinstance(values, str):
        return F.substring(F.lit(values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"), F.lit(1))
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def _substitute(text: Column, seed: Column) -> Column:
    """Each letter or digit becomes one of its own script, case and kind; other signs stay."""

    def one(c: Column, i: Column) -> Column:
        n, out = F.xxhash64(seed, i), None
        for kind, letters in ALPHABETS:
            hit = c.rlike(f"^[{kind}]$")
            out = F.when(hit, _pick(letters, n)) if out is None else out.when(hit, _pick(letters, n))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(digits: Column, seed: Column, keep: Column, high: list[int]) -> Column:
    """Digits in place of ``digits`` but the first ``keep``; no 0 or 1 at the places ``high`` after those."""

    def one(c: Column, i: Column) -> Column:
        n = F.xxhash64(seed, i)
        return F.when(i < keep, c).when((i - keep).isin(high), (F.pmod(n, F.lit(8)) + 2).cast("string")).otherwise(F.pmod(n, F.lit(10)).cast("string"))

    return F.array_join(F.transform(F.split(digits, ""), one), "")


def _luhn(digits: Column, first_doubled: int) -> Column:
    """Luhn's sum over ``digits`` from the right, doubling every other from ``first_doubled`` (0 or 1) on."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == first_doubled, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def _surrogate(key: str) -> Column:
    """From (kind, canon, attempt), a canonical surrogate."""
    # Short forms can run out of free values; then the surrogate gets longer.
    longer = lambda x: F.when(F.col("attempt") < 8, x).otherwise(F.repeat(x, 4))
    canon, again = F.col("canon"), F.col("attempt").cast("string")
    seed = _seed(F.lit(key), F.col("kind"), canon, again)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)(\.[a-z]+)$", 1)
    email = F.concat(_substitute(longer(local), seed), F.lit("@"), _substitute(labels, _seed(F.lit(key), F.lit("domain"), domain)), F.regexp_extract(domain, r"(\.[a-z]+)$", 1))
    octet = lambda i, low, n: (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(n)) + low).cast("string")
    net = F.regexp_extract(canon, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.)", 1)
    ip = F.when(net == "", F.concat_ws(".", octet(0, 20, 80), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
    # Networks of 65,536 addresses or so can run out of free ones; then the address moves to the largest private one.
    ip = ip.when((F.col("attempt") >= 8) & ~net.isin("10.", "127."), F.concat(F.lit("10."), F.concat_ws(".", octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))))
    ip = ip.when(net.rlike(r"^\d+\.$"), F.concat(net, F.concat_ws(".", octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))))
    ip = ip.otherwise(F.concat(net, F.concat_ws(".", octet(2, 0, 256), octet(3, 1, 254))))
    plus = canon.startswith("+")
    code = F.when(~plus, 0).when(canon.rlike(r"^\+[17]"), 1).otherwise(2)
    phone = F.concat(F.when(plus, "+").otherwise(""), _digits(F.regexp_replace(canon, r"\+", ""), seed, code, [0, 3]))
    body = _digits(F.substring(canon, F.lit(1), F.length(canon) - 1), seed, F.lit(1), [])
    card = F.concat(body, F.pmod(-_luhn(body, 0), F.lit(10)).cast("string"))
    ssn = F.concat((F.pmod(F.xxhash64(seed, F.lit(0)), F.lit(565)) + 101).cast("string"), F.lpad((F.pmod(F.xxhash64(seed, F.lit(1)), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(9999)) + 1).cast("string"), 4, "0"))
    head = F.regexp_extract(canon, r"^(AKIA|ASIA|ghp_|gho_|sk-|xoxb-)?", 1)
    secret = F.concat(head, F.when(canon.rlike("^[0-9a-f]+$"), F.substring(F.sha2(seed.cast("string"), 256), F.lit(1), F.length(longer(canon)))).otherwise(_substitute(longer(F.substring(canon, F.length(head) + 1, F.length(canon))), seed)))
    out = F.when(F.col("kind") == "email", email).when(F.col("kind") == "ip", ip).when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", card).when(F.col("kind") == "ssn", ssn).when(F.col("kind") == "secret", secret)
    n = [F.xxhash64(seed, F.lit(i)) for i in range(4)]
    short, more = F.col("attempt") < 1, F.col("attempt") < 6

    def family(script: str, syllables: Column) -> Column:
        """A name of so many syllables and an ending: each attempt has a longer one to choose from."""
        front, back = (x.split() for x in FAMILY[script])
        return F.concat(F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: _pick(front, F.xxhash64(seed, F.lit("syllable"), i))), "")), _pick(back, n[3]))

    for (sex, script), names in GIVEN.items():
        pool, mine = names.split(), F.col("kind") == f"given_{sex}_{script}"
        out = out.when(mine & short, _pick(pool, n[0])).when(mine & more, F.concat(_pick(pool, n[0]), F.lit("-"), _pick(pool, n[1])))
        out = out.when(mine, F.concat(_pick(pool, n[0]), F.lit("-"), family(script, F.col("attempt") - 4)))
    for script in FAMILY:
        out = out.when(F.col("kind") == f"family_{script}", family(script, F.col("attempt") + 1))
    return out.otherwise(_substitute(longer(canon), seed))


def _class() -> Column:
    """Surrogates of one class must differ."""
    return F.regexp_extract("kind", "^[a-z]+", 0)


def _joined(tokens: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(tokens, first + 1, n), "")


def _inside(tokens: Column) -> Column:
    """The entities in a span of ``NUMBERS``, from left to right: array of (at, c, n, kind).

    ``tokens`` are its groups of digits, each with the sign after it; an entity has n signs, from
    group ``at`` (from 0) on, and touches c groups. At each group that is free yet: an IPv4
    address, a social security or phone number in its own format, or the longest 13 to 19
    digits that are Luhn valid and end a group. Groups of a card have four digits or more
    but for the last, or else lists of numbers would hold many; only the longest match at
    the start of the span may be grouped in any way.
    """

    # Steps of their own, so that each match is made once for each group.
    def ahead(_token: Column, i: Column) -> Column:
        return F.struct(i.alias("at"), F.substring(_joined(tokens, i, F.lit(20)), 1, 60).alias("text"), F.when(i == 0, "").otherwise(F.right(F.get(tokens, i - 1), F.lit(1))).alias("sign"))

    def matches(x: Column) -> Column:
        match = lambda p: F.regexp_extract(x["text"], f"^(?:{p})", 0)
        longest = match(r"\d(?:[ \-]?\d){12,18}(?!\d)")
        cards = F.when(longest == "", F.array().cast("array<string>")).otherwise(F.array(*[match(rf"\d(?:[ \-]?\d){{{more}}}(?!\d)") for more in range(18, 11, -1)]))
        return F.struct(x["at"].alias("at"), x["sign"].alias("sign"), *[match(p).alias(kind) for p, kind in ((IP, "ip"), (SSN, "ssn"), (PLAIN_PHONE, "phone"))], longest.alias("longest"), cards.alias("cards"))

    def found(x: Column) -> Column:
        def usual(card: Column) -> Column:
            grouped = card.rlike(r"^\d{4,}(?:[ \-]\d{4,})*(?:[ \-]\d{1,3})?$") | ((x["at"] == 0) & (card == x["longest"]))
            return (card != "") & grouped & (_luhn(F.regexp_replace(card, r"\D", ""), 1) % 10 == 0)

        text = F.when((x["sign"] != ".") & (x["ip"] != ""), F.array(x["ip"], F.lit("ip"))).when((x["sign"] != "-") & (x["ssn"] != ""), F.array(x["ssn"], F.lit("ssn")))
        text = text.when(~x["sign"].isin("-", ".") & (x["phone"] != ""), F.array(x["phone"], F.lit("phone")))
        card = F.when(x["sign"].isin("-", "."), F.lit(None).cast("string")).otherwise(F.get(F.filter(x["cards"], usual), F.lit(0)))
        return F.struct(x["at"].alias("at"), F.coalesce(text, F.when(card.isNotNull(), F.array(card, F.lit("card")))).alias("hit"))

    def sized(x: Column) -> Column:
        text = F.get(x["hit"], F.lit(0))
        return F.struct(x["at"].alias("at"), F.size(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)).alias("c"), F.length(text).alias("n"), F.get(x["hit"], F.lit(1)).alias("kind"))

    each = F.transform(F.transform(F.transform(tokens, ahead), matches), found)
    each = F.transform(F.filter(each, lambda x: x["hit"].isNotNull()), sized)
    none = F.array().cast("array<struct<at:int,c:int,n:int,kind:string>>")
    free = lambda a: F.when(F.size(a) == 0, 0).otherwise(F.element_at(a, -1)["at"] + F.element_at(a, -1)["c"])
    return F.aggregate(each, none, lambda a, x: F.when(F.coalesce(x["at"] >= free(a), F.lit(True)), F.concat(a, F.array(x))).otherwise(a))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, i, j, m, before, surface, after, kind, canon): part j of the span at place i; parts of one entity have the same m; a span without an entity has one part of kind none; t is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1)).alias("i", "e")).dropDuplicates(["k", "t", "i"])
    e = F.col("e")
    numbers = e.rlike(r"^\d(?:[ .\-]?\d){12}") & e.rlike(r"^\d++(?:[ .\-]\d++)*+[\w\-]?$") & ~e.rlike("^[0-9a-f]{32,64}$")
    kind = F.when(e.contains("@"), "email").when(e.rlike(f"^(?:{IP})$"), "ip").when(e.rlike(f"^(?:{SSN})$"), "ssn")
    kind = kind.when(numbers, "numbers")
    kind = kind.when(e.rlike(r"^[+(\d][\d ().\-]+$"), "phone").when(e.rlike(f"^(?:{FEMALE}|{MALE}|{NEUTRAL})\\.? {NAME_WORD}"), "name").otherwise("secret")
    found = found.withColumn("kind", kind)
    # A label such as password= stays; what it labels is replaced.
    label = F.regexp_extract(e, r"^((?i:[a-z_\-]+)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)?", 1)
    before = F.when(F.col("kind") == "secret", label).otherwise("")
    surface = F.when(F.col("kind") == "secret", F.substring(e, F.length(label) + 1, F.length(e))).otherwise(e)
    simple = found.where("kind not in ('name', 'numbers')").select("k", "t", "i", F.lit(0).alias("j"), F.lit(0).alias("m"), before.alias("before"), surface.alias("surface"), F.lit("").alias("after"), "kind")
    held = found.where("kind = 'numbers'").select("k", "t", "i", F.regexp_extract_all(e, F.lit(r"(\d+\D?)"), 1).alias("g"))
    held = held.select("k", "t", "i", "g", _inside(F.col("g")).alias("a"))
    bare = held.where("size(a) = 0").select("k", "t", "i", F.lit(0).alias("j"), F.lit(-1).alias("m"), F.array_join("g", "").alias("before"), F.lit("").alias("surface"), F.lit("").alias("after"), F.lit("none").alias("kind"))

    def part(x: Column, j: Column) -> Column:
        past = F.when(j == 0, 0).otherwise(F.get("a", j - 1)["at"] + F.get("a", j - 1)["c"])
        own = _joined(F.col("g"), x["at"], x["c"])
        rest = F.when(j == F.size("a") - 1, _joined(F.col("g"), x["at"] + x["c"], F.size("g"))).otherwise("")
        sign = F.substring(own, x["n"] + 1, F.length(own))
        return F.struct(_joined(F.col("g"), past, x["at"] - past).alias("before"), F.substring(own, F.lit(1), x["n"]).alias("surface"), F.concat(sign, rest).alias("after"), x["kind"].alias("kind"))

    held = held.where("size(a) > 0").select("k", "t", "i", F.posexplode(F.transform("a", part)).alias("j", "x")).select("k", "t", "i", "j", F.col("j").alias("m"), "x.*")
    title = F.regexp_extract(e, f"^({FEMALE}|{MALE}|{NEUTRAL})", 1)
    sex = F.when(title.rlike(f"^(?:{FEMALE})$"), "f").when(title.rlike(f"^(?:{MALE})$"), "m").otherwise("n")
    named = found.where("kind = 'name'").select("k", "t", "i", F.regexp_extract(e, r"^(\S+ )", 1).alias("title"), sex.alias("sex"), F.split(F.regexp_replace(e, r"^\S+ ", ""), " ").alias("names"))
    named = named.select("k", "t", "i", "title", "sex", F.size("names").alias("n"), F.posexplode("names").alias("j", "surface"))
    known = {s: " ".join(v for (x, _), v in GIVEN.items() if x == s).lower().split() for s in "fm"}
    lower = F.lower("surface")
    sex = F.when(lower.isin(known["f"]), "f").when(lower.isin(known["m"]), "m").otherwise(F.col("sex"))
    script = F.when(F.col("surface").rlike(r"^[\p{IsLatin}'’\-]+$"), "latin").when(F.col("surface").rlike(r"^[\p{IsCyrillic}'’\-]+$"), "cyrillic").otherwise("other")
    role = F.when((F.col("n") == 2) & (F.col("j") == 0), F.concat_ws("_", F.lit("given"), sex, script)).otherwise(F.concat_ws("_", F.lit("family"), script))
    named = named.select("k", "t", "i", "j", F.lit(0).alias("m"), F.when(F.col("j") == 0, F.col("title")).otherwise(" ").alias("before"), "surface", F.lit("").alias("after"), role.alias("kind"))
    canon = F.when(F.col("kind").isin("card", "ssn"), F.regexp_replace("surface", r"\D", "")).when(F.col("kind") == "phone", F.regexp_replace("surface", r"[^+\d]", "")).when(F.col("kind").isin("ip", "secret"), F.col("surface"))
    canon = canon.when(F.col("kind").rlike("^(given|family)"), F.initcap("surface")).otherwise(F.lower("surface"))
    return simple.union(held).union(bare).union(named).withColumn("canon", canon)


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): one for each distinct value of ``found``; distinct within a class and equal to no real value of it.

    Rounds run until no collision is left. In each, of those with one surrogate the value
    that comes first keeps it, unless the surrogate is a real value; the others try the
    next attempt. Groups are reduced to their minimum, never gathered. Names, e-mail
    addresses and secrets get longer with the attempts, and private addresses move to the
    largest private network. Where the format leaves no free value (short phone numbers,
    once half of all there are real), ``ATTEMPTS`` rounds end in a ValueError.
    """
    open_ = written(found.where("kind <> 'none'").groupBy("kind", "canon").agg(F.lit(0).alias("attempt")).withColumn("class", _class()), "entities")
    real_in = open_
    real = open_.select("class", F.col("canon").alias("surrogate")).distinct()
    settled = None
    for _ in range(ATTEMPTS):
        tried = written(open_.withColumn("surrogate", _surrogate(key)), "tried")
        first = tried.join(real, ["class", "surrogate"], "left_anti").groupBy("class", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("first"))
        if settled is not None:
            first = first.join(settled.select("class", "surrogate"), ["class", "surrogate"], "left_anti")
        won = written(first.select("class", "surrogate", "first.kind", "first.canon"), "won")
        settled = won if settled is None else settled.union(won)
        old, open_ = open_, written(tried.join(won, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("surrogate"), "open")
        if real_in is not old:
            dropped(old)
        dropped(tried)
        if open_.isEmpty():
            return settled.select("kind", "canon", "surrogate")
    lacking = sorted(r.kind for r in open_.select("kind").distinct().collect())
    raise ValueError(f"no free surrogates of the same format for values of {', '.join(lacking)}")


def _rendered() -> Column:
    """The surrogate in the format of the surface."""
    surface, s = F.col("surface"), F.col("surrogate")
    fresh = F.regexp_replace(s, r"\D", "")
    filled = F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(fresh, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    cased = F.when((F.upper(surface) == surface) & (F.length(surface) > 1), F.upper(s)).when(F.lower(surface) == surface, F.lower(s)).otherwise(s)
    return F.when(F.col("kind").isin("phone", "card", "ssn"), filled).when(F.col("kind").isin("ip", "secret"), s).otherwise(cased)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with detected entities of ``text_col`` replaced by surrogates; adds n_entities long.

    Kinds: e-mail addresses, secrets (access keys, tokens, quoted hex keys, labelled
    passwords), IPv4 addresses, payment cards (Luhn valid, and so is the surrogate), US social
    security numbers, phone numbers (+ and country code kept), names after a title (gender by
    known given name, else by title; script kept). One real value gets one surrogate in all
    documents and spellings, two values never the same one, and no surrogate is a real value.

    A null text stays null with 0 entities; an empty text stays empty; a null id keeps its row;
    repeated rows are treated alike and stay repeated. A column named n_entities is replaced;
    other names don't matter. An empty table gives an empty one. Only documents with an
    entity are shuffled; the others pass through.
    """
    found = written(mentions(docs, id_col, text_col), "mentions")
    table = surrogates(found, key)
    fill = F.struct("i", "j", "m", F.concat("before", F.when(F.col("kind") == "none", "").otherwise(_rendered()), "after").alias("r"))
    parts = found.join(table, ["kind", "canon"]).select("k", "t", "i", fill.alias("p"))
    parts = parts.union(found.where("kind = 'none'").withColumn("surrogate", F.lit("")).select("k", "t", "i", fill.alias("p")))
    new = parts.groupBy("k", "t").agg(F.sort_array(F.collect_list("p")).alias("p"))
    new = new.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("p").alias("__p"))
    columns = [c for c in docs.columns if c != "n_entities"]
    hit = F.coalesce(F.col(text_col).rlike(ENTITY), F.lit(False))
    plain = docs.where(~hit).select(*columns, F.lit(0).cast("long").alias("n_entities"))
    own = docs.where(hit).select(*columns, F.xxhash64(text_col).alias("__h"))
    both = own.join(new, own[id_col].eqNullSafe(new["__k"]) & (own["__h"] == new["__t"]), "left")
    # Each span has one part or more, so the parts in their order, each first one after the text before its span, are the text.
    cut = both.select(*columns, "__p", F.split(text_col, ENTITY, -1).alias("__rest"))
    whole = F.concat(F.array_join(F.transform("__p", lambda x: F.concat(F.when(x["j"] == 0, F.get("__rest", x["i"])).otherwise(""), x["r"])), ""), F.element_at("__rest", -1))
    n = F.coalesce(F.size(F.filter("__p", lambda x: x["j"] == x["m"])), F.lit(0)).cast("long")
    done = cut.select(*[F.when(F.col("__p").isNull(), F.col(c)).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in columns], F.when(F.col("__p").isNull(), 0).otherwise(n).cast("long").alias("n_entities"))
    return plain.union(done)

