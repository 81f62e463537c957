"""Personal data is replaced by keyed surrogates of the same type, gender, script and format.

Detection is one pass of a regular expression over whole texts (without its part for mail where a text has no
``@``), and a second look in the texts that name persons: a name found there is found wherever it stands in that
text. Texts are written once with their entities set apart, and all later steps read that. Every distinct entity of the corpus gets one surrogate,
a function of the secret key, its type, its canonical form and an attempt number, so all mentions of an entity
change alike (coreference). A collision check compares the surrogates of all distinct entities: two entities
may not share one and a surrogate may not be an entity that occurs in the corpus (given names of the
lists apart, which are permuted among themselves). Losers take the next attempt until none is left; after
``PLAIN`` attempts their surrogates get longer with every further one, so small formats never run out.

Everything is DataFrame functions. Only distinct entities are shuffled to find surrogates; texts without an
entity are never shuffled. Texts with the same entities share one list of replacements, and only lists and entities
counted as hot are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut_lineage

from . import common

#: Attempts in the entity's own format; later ones are one character (or syllable) longer each.
PLAIN = 8
#: Given names by script and gender (fixed values). A name is replaced by another of its own list.
GIVEN = {
    "latin_female": "Anna Maria Julia Laura Sophie Emma Clara Lucia Elena Camille Ingrid Katharina Isabel Carmen Alice Margaret".split(),
    "latin_male": "John James Robert Michael Thomas Peter Hans Stefan Carlos Miguel Pierre Antoine Jürgen Rafael William George".split(),
    "cyrillic_female": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "cyrillic_male": "Иван Сергей Дмитрий Николай Михаил Андрей Владимир Алексей".split(),
    "greek_female": "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική".split(),
    "greek_male": "Γιώργος Δημήτρης Νίκος Παναγιώτης Βασίλης Χρήστος".split(),
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Господин", "Госпожа", "Κύριος", "Κυρία"]
#: Endings of surnames that show a gender; they stay.
GENDERED = "(ova|eva|ska|ov|ev|ski|ова|ева|ина|ская|ов|ев|ин|ский|πούλου|ίδου|όπουλος|ίδης)$"
ALPHABETS = {"digit": "0123456789", "hex": "0123456789abcdef", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Characters outside ASCII by class, the first that holds; letters of other scripts become Latin ones.
OTHERS = [(r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
          (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
          (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"), (r"\p{IsLatin}", "àáâäåçèéêëìíîïñòóôöùúûü"),
          (r"\p{IsHan}", "一丁七三上下不中主九也了事二于五人今他以们会位住何作使来便保信個先光入全公六其具内再出分前力"),
          (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
          (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
          (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"),
          (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789")]
#: What the other characters of a secret become.
SYMBOLS = "!#$%&*+-./:=?@^_|~"
#: Consonants and vowels of made-up names, by script.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}

_known = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"
_titles = "(?:" + "|".join(TITLES) + ")"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Letters of scripts that are written without spaces (or, Hangul, with endings right after a foreign word).
_unspaced = (r"\u0E00-\u0EFF\u1000-\u109F\u1100-\u11FF\u1780-\u17FF\u3005-\u3007\u3041-\u30FF\u3131-\u318E\u31F0-\u31FF\u3400-\u4DBF"
             r"\u4E00-\u9FFF\uAC00-\uD7A3\uF900-\uFAFF\uFF66-\uFFDC\x{20000}-\x{323AF}")
_alnum = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_unspaced}]]"
#: The local part has letters of any script; it starts where an unspaced script ends, or is a whole run of such a script.
EMAIL = rf"(?:[A-Za-z0-9{_alnum}][A-Za-z0-9._%+\-{_alnum}]*+|[{_unspaced}]++)@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}"
#: Where a mail address may start. After a sign that follows a letter an earlier start has failed at the same '@',
#: unless another entity ends there; so a long run of letters and signs is not read again from each of its places.
EMAIL_START = (rf"(?:(?=[A-Za-z0-9{_alnum}])(?:(?<![A-Za-z0-9{_alnum}])(?:(?<![._%+-])|(?<![A-Za-z0-9{_alnum}][._%+-]{{1,8}})|(?<=\G[._%+-]{{1,8}}))|\G)"
               rf"|(?=[^\x00-\x7F])(?=[{_unspaced}])(?<![{_unspaced}]))")
KEY_ID = r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?<==)(?<=[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]=)[^\s\"'<>,;]{4,}+"
HEX_TOKEN = r"(?<=\")[0-9a-fA-F]{32,64}(?=\")"
ADDRESS = rf"(?<![0-9]\.){_octet}\.{_octet}\.{_octet}\.{_octet}(?![0-9])(?!\.[0-9])"
CARD = r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}(?![0-9])|(?<!-)[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}(?![0-9-])"
NATIONAL = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NUMBERS = rf"(?=[0-9+(])(?:{ADDRESS}|{CARD}|{PHONE}|{NATIONAL})"
NAME = (rf"(?=\p{{Lu}}\p{{L}})(?:{_known}(?= \p{{Lu}}\p{{Ll}})"
        rf"|(?<=[\p{{L}}.] )(?:(?<=(?<!\p{{L}}){_titles}\.? )|(?<=(?<!\p{{L}}){_known} ))\p{{Lu}}\p{{L}}{{1,30}})")
_mail = rf"{EMAIL_START}{EMAIL}"


def _pattern(mail: str) -> str:
    return (rf"(?:(?=[0-9+(])(?<![0-9])(?:{NUMBERS})|(?=AKIA)(?<![A-Za-z0-9]){KEY_ID}|{mail}{PASSWORD}|{HEX_TOKEN}"
            rf"|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{NAME}))")


#: No entity starts after a character that could continue its kind; each kind begins with a test that most places fail.
PATTERN = _pattern(f"{_mail}|")
WITHOUT_MAIL = _pattern("")
#: Signs that set entities apart; a text that has them itself is taken apart in another way.
OPEN, CLOSE = "\x01", "\x02"


def parts(text: Column) -> Column:
    """The text as gap, entity, gap, ..., gap; one gap if there is no entity."""
    def marked(pattern):
        return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    gaps, raws = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    woven = F.flatten(F.zip_with(gaps, raws, lambda g, r: F.when(r.isNull(), F.array(g)).otherwise(F.array(g, r))))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), woven).when(text.contains("@"), marked(PATTERN)).otherwise(marked(WITHOUT_MAIL))


def entities(of: Column) -> Column:
    return F.filter(of, lambda _, i: i % 2 == 1)


def names_again(of: Column) -> Column:
    """Parts in which the names among the entities are entities wherever they stand as words."""
    names = F.array_distinct(F.filter(entities(of), lambda e: e.rlike("^\\p{Lu}\\p{L}+$")))
    word = F.concat(F.lit("(?<![\\p{L}\\p{M}\\p{N}])(?:"), F.array_join(names, "|"), F.lit(")(?![\\p{L}\\p{M}\\p{N}])"))
    again = F.array_join(F.transform(of, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(OPEN), x, F.lit(CLOSE))).otherwise(
        F.regexp_replace(x, word, F.lit(f"{OPEN}$0{CLOSE}")))), "")
    own = F.exists(of, lambda x: x.contains(OPEN) | x.contains(CLOSE))
    return F.when((F.size(names) > 0) & ~own, F.split(again, f"[{OPEN}{CLOSE}]", -1)).otherwise(of)


def kind_of(e: Column) -> Column:
    """Type of a detected entity, from its own characters."""
    digits = F.length(F.regexp_replace(e, "[^0-9]", ""))
    return (F.when(e.rlike(f"^{EMAIL}$"), "email").when(e.rlike("^AKIA[0-9A-Z]{16}$"), "key").when(e.rlike(rf"^(?:{_octet}\.){{3}}{_octet}$"), "address")
            .when(e.rlike("^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$"), "card").when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
            .when(e.rlike("^[+(0-9][-+() 0-9]+$") & digits.between(7, 15) & e.rlike("[-+() ]"), "phone")
            .when(e.rlike("^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$"), "hex")
            .when(e.rlike(f"^{_known}$"), "given").when(e.rlike("^\\p{Lu}\\p{L}+$"), "name").otherwise("secret"))


def canonical(e: Column, kind: Column) -> Column:
    """What two spellings of one entity share: digits of numbers (of a phone the last ten), lower case of names and mail."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (F.when(kind.isin("card", "national"), digits).when(kind == "phone", F.substring(digits, -10, 10))
            .when(kind.isin("email", "name", "hex"), F.lower(e)).otherwise(e))


def _hash(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """256 hex digits that depend on the key."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt)))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}\x1e{i}\x1e"), F.sha2(seed, 256)), 256) for i in range(4)])


def _number(h: Column, i: Column) -> Column:
    """The i-th three-digit hex number of the hash, from 0; beyond its end it starts again."""
    return F.conv(h.substr((i % 84) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _char(alphabet: str, n: Column) -> Column:
    return F.lit(alphabet).substr(n % len(alphabet) + 1, F.lit(1))


def _places(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1)).otherwise(F.array().cast("array<int>"))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _like(c: Column, h: Column, hexadecimal: Column, skip: int = 0, symbols: Column | None = None) -> Column:
    """Every digit and letter becomes another of its class, where ``symbols`` holds every other character too."""
    kept = F.lit(None).cast("string") if symbols is None else F.when(symbols, F.lit(SYMBOLS))

    def one(x, i):
        of = (F.when(i < skip, F.lit(None).cast("string")).when(hexadecimal, ALPHABETS["hex"]).when(x.rlike("[0-9]"), ALPHABETS["digit"])
              .when(x.rlike("[a-z]"), ALPHABETS["lower"]).when(x.rlike("[A-Z]"), ALPHABETS["upper"]).when(x.rlike("^[\\x00-\\x7F]$"), kept))
        for pattern, alphabet in OTHERS:
            of = of.when(x.rlike(pattern), alphabet)
        of = of.otherwise(kept)
        return F.coalesce(of.substr(_number(h, i) % F.length(of) + 1, F.lit(1)), x)
    return F.array_join(F.transform(_chars(c), one), "")


def _tail(alphabet: str, h: Column, length: int) -> Column:
    """Further characters of a surrogate whose format is used up."""
    return F.concat(F.lit(""), *[_char(alphabet, _number(F.sha2(F.concat(h, F.lit(f"tail{i // 16}")), 256), F.lit(i % 16))) for i in range(length)])


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule modulo 10."""
    n = F.length(digits)

    def one(i):
        d = digits.substr(i + 1, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(_places(digits), one), F.lit(0), lambda a, x: a + x) % 10


def _made_up_name(canon: Column, h: Column, more: int = 0) -> Column:
    """Two to four syllables (and ``more``) in the script of the name, with its gendered ending."""
    ending = F.regexp_extract(canon, GENDERED, 1)
    count = F.greatest(F.lit(2), F.least(F.lit(4), ((F.length(canon) - F.length(ending)) / 2).cast("int"))) + more

    def of(script):
        consonants, vowels = SOUNDS[script]
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(_char(consonants, _number(h, 2 * i)), _char(vowels, _number(h, 2 * i + 1)))), "")
    body = F.when(canon.rlike("\\p{IsCyrillic}"), of("cyrillic")).when(canon.rlike("\\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    return F.concat(body, ending)


def surrogate(kind: Column, canon: Column, attempt: int, h: Column) -> Column:
    """Candidate for the canonical form from its hash of the attempt; from attempt ``PLAIN`` on longer than it.

    Telephone numbers first give up their exchange; numbers of a fixed length grow four attempts later.
    """
    wide = max(0, attempt - PLAIN + 1)
    more = max(0, wide - 4)
    no = F.lit(False)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.split(domain, "\\.")
    host = F.array_join(F.transform(labels, lambda x, i: F.when((i == F.size(labels) - 1) | (x == "example"), x).otherwise(
        _like(x, F.sha2(F.concat(h, x), 256), no))), ".")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(h, i) % 254 + 1).cast("string")), ".")
    free = F.concat(F.substring(canon, 1, 1), _like(canon.substr(F.lit(2), F.length(canon) - 2), h, no))
    # the last digit keeps the Luhn sum of the number, right or wrong
    check = (_luhn(canon) - _luhn(F.concat(free, F.lit("0"))) + 10) % 10
    card = F.concat(free, check.cast("string"), _tail(ALPHABETS["digit"], h, more))
    phone = F.when(F.length(canon) == 10, F.concat((_number(h, F.lit(80)) % 8 + 2).cast("string"), _like(canon.substr(2, 2), h, no), F.substring(canon, 4, 3) if not wide else _like(F.substring(canon, 4, 3), F.sha2(F.concat(h, F.lit("exchange")), 256), no),
                                                   _like(F.substring(canon, -4, 4), F.sha2(h, 256), no))).otherwise(_like(canon, h, no))
    phone = F.concat(phone, _tail(ALPHABETS["digit"], h, more))
    name = _made_up_name(canon, h, wide)
    port = F.concat(F.lit(":" if more else ""), _tail("123456789", h, more))
    # numbers that are no telephone number keep their signs
    figures = canon.rlike("^[-+() ]*[0-9][-+() 0-9]*$")
    secret = F.concat(_like(canon, h, no, symbols=~figures), F.when(figures, _tail(ALPHABETS["digit"], h, wide)).otherwise(_tail(ALPHABETS["lower"], h, wide)))
    return (F.when(kind == "email", F.concat(_like(local, h, no), _tail(ALPHABETS["lower"], h, wide), F.lit("@"), host))
            .when(kind == "key", F.concat(_like(canon, h, no, 4), _tail(ALPHABETS["upper"], h, wide)))
            .when(kind == "address", F.concat(octets, port)).when(kind == "card", card).when(kind == "phone", phone).when(kind == "name", name)
            .when(kind == "hex", F.concat(_like(canon, h, F.lit(True)), _tail(ALPHABETS["hex"], h, wide)))
            .when(kind == "national", F.concat(_like(canon, h, no), _tail(ALPHABETS["digit"], h, more))).otherwise(secret))


def _given(e: Column, key: str) -> Column:
    """A keyed rotation of each list, so distinct names stay distinct and none stays as it is."""
    import hashlib
    import hmac
    pairs = []
    for label, names in GIVEN.items():
        dealt = sorted(names, key=lambda n: hmac.new(key.encode(), f"{label}|{n}".encode(), hashlib.sha256).digest())
        pairs += [(a, b) for a, b in zip(dealt, dealt[1:] + dealt[:1])]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])[e]


def _layout(raw: Column, kind: Column, core: Column, canon: Column) -> Column:
    """The surrogate in the format of one mention: its separators, country code and letter case; what is longer follows."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    lead = digits - F.length(canon)

    def digit(i):
        x = raw.substr(i + 1, F.lit(1))
        before = F.length(F.regexp_replace(raw.substr(F.lit(1), i), "[^0-9]", ""))
        return F.when(x.rlike("[0-9]") & (before >= lead), core.substr(before - lead + 1, F.lit(1))).otherwise(x)

    def cased(a, b):
        return F.array_join(F.zip_with(_chars(a), _chars(b), lambda x, y: F.when(x.rlike("\\p{Lu}"), F.upper(y)).otherwise(y)), "")

    def part(c, n):
        return F.substring_index(c, "@", n)

    numbers = F.concat(F.array_join(F.transform(_places(raw), digit), ""), core.substr(F.length(canon) + 1, F.length(core)))
    mail = F.concat(cased(part(raw, 1), part(core, 1)), F.lit("@"), cased(part(raw, -1), part(core, -1)))
    name = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(core)).otherwise(F.concat(F.upper(F.substring(core, 1, 1)), core.substr(F.lit(2), F.length(core))))
    return F.when(kind.isin("card", "national", "phone"), numbers).when(kind == "email", mail).when(kind == "hex", cased(raw, core)).when(kind == "name", name).otherwise(core)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, core for distinct (kind, canon) rows; distinct entities never share a core.

    It always ends: from round ``PLAIN`` on the surrogates of the losers grow, so each further round has
    many times the values of the last one, and soon more characters than any entity.
    """
    real = entities.select("kind", F.col("canon").alias("core"))
    pending, done, attempt = entities, None, 0
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # a row is small and its surrogate is work: by number of tasks, not by size
        pending = pending.repartition(tasks, "kind", "canon")
        cand = pending.withColumn("_h", _hash(F.col("kind"), F.col("canon"), attempt, key))
        cand = cand.withColumn("core", surrogate(F.col("kind"), F.col("canon"), attempt, F.col("_h")))
        taken = real if done is None else real.unionByName(done.select("kind", "core"))
        free = cand.join(taken, ["kind", "core"], "left_anti")
        won = free.groupBy("kind", "core").agg(F.min("canon").alias("canon"))
        won = cut_lineage(won.select("kind", "canon", "core"))
        done = won if done is None else done.unionByName(won)
        pending = cut_lineage(pending.join(won, ["kind", "canon"], "left_anti"))
        if not pending.limit(1).count():
            return done
        attempt += 1


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs with rewritten texts and a column that counts the replaced mentions; returns (frame, name of that column).

    Null texts stay null, texts without an entity stay as they are. All columns and all rows are kept.
    """
    count, mark, split, own = "_pii_count", "_pii_map", "_pii_parts", "_pii_key"
    cols = [F.col(f"`{c}`") for c in docs.columns if c != text]
    apart = common.stored(docs.select(*cols, parts(F.col(text)).alias(split)).withColumn(split, names_again(F.col(split))), "pii-parts", "snappy")
    has = F.coalesce(F.size(split) > 1, F.lit(False))
    keyed = F.md5(F.to_json(F.array_sort(F.array_distinct(entities(F.col(split))))))
    # texts with the same entities meet here once
    lists = apart.where(has).select(keyed.alias(own), F.array_distinct(entities(F.col(split))).alias("raws")).groupBy(own).agg(F.first("raws").alias("raws"))
    found = lists.select(own, F.explode("raws").alias("raw"))
    found = found.withColumn("kind", kind_of(F.col("raw"))).withColumn("canon", canonical(F.col("raw"), F.col("kind")))
    found = cut_lineage(found)
    mapping = assign(cut_lineage(found.where("kind <> 'given'").select("kind", "canon").distinct()), key)
    named = found.where("kind <> 'given'").withColumn("entity", F.concat_ws("\x1f", "kind", "canon"))
    mapping = mapping.select(F.concat_ws("\x1f", "kind", "canon").alias("entity"), "core")
    joined = common.join_hot(named, mapping, "entity", F.col(own)).select(own, "raw", _layout(F.col("raw"), F.col("kind"), F.col("core"), F.col("canon")).alias("new"))
    given = found.where("kind = 'given'").select(own, "raw", _given(F.col("raw"), key).alias("new"))
    per_list = cut_lineage(joined.unionByName(given).groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias(mark)))
    both = common.join_hot(apart.where(has).withColumn(own, keyed), per_list, own, F.col(split))
    rebuilt = F.array_join(F.transform(split, lambda x, i: F.when(i % 2 == 1, F.element_at(F.col(mark), x)).otherwise(x)), "")
    changed = both.select(*cols, rebuilt.alias(text), F.size(entities(F.col(split))).cast("long").alias(count))
    same = apart.where(~has).select(*cols, F.col(split)[0].alias(text), F.lit(0).cast("long").alias(count))
    return same.unionByName(changed), count


#: Session setting that holds the secret key, and a stand-in where it is not set.
KEY_SETTING = "spark.corpusloom.surrogateKey"
DEFAULT_KEY = "surrogate-key"


def op2_pii_surrogates(spark, folder: str) -> DataFrame:
    """doc_id, rewritten whole text, number of replaced mentions."""
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    out, count = replace_entities(docs, spark.conf.get(KEY_SETTING, DEFAULT_KEY))
    return out.select("doc_id", "text", F.col(count).alias("n_replaced"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: texts rewritten, n_chars (where it exists) follows the new text; no row is dropped."""
    out, count = replace_entities(docs, spark.conf.get(KEY_SETTING, DEFAULT_KEY))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
