"""PII by surrogate generation, in DataFrame functions only.

Personal data and secrets are found by one pattern, and every distinct entity
gets one keyed surrogate of its kind: e-mail addresses keep the shape of their
local part and get a reserved domain, phone numbers and cards keep their
punctuation and digit count (cards also a right check digit), network addresses
stay network addresses (of private or documentation ranges), account numbers get
right check digits, international phone numbers keep their country code, secrets
keep their alphabet and prefix, names keep title, gender, script and number of
words. A name's gender is its title's or given name's; mentions that tell none are
the one that others of the same name tell, if those agree. An entity is compared in a canonical form
(lower case, digits alone, name without its title), so all its mentions, however
written, get the same surrogate, in capitals where a name or hexadecimal secret is
written so.

Surrogates are checked against each other and against all real entities of their
kind; where two would coincide, or one would be a real entity, the smallest keeps
its draw and the others draw again until none is left, so distinct entities stay
distinct. What is unsettled after ``GROW`` draws grows by a syllable (names) or a
digit (all else; IPv4 addresses turn into IPv6 ones) in each further draw.

Texts are joined to their replacements by a digest of the text, one row per
distinct text with entities; a text is rebuilt from the pieces between mentions.
Texts that a bounded sample shows to be frequent (empty ones, say) are dealt to
all tasks by a hash of their other columns.

Defined results: null text stays null and has no entities; a repeated row or text
gets the same replacements; a very long text is one row, searched in its task; an
empty table gives an empty table; input columns named like an output, in any case,
are replaced, all others are kept.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import even_join, frequent_values, materialise

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
#: What introduces a secret, in any case, after a word's start or _ (db_password, API_KEY, "Password": ).
SECRET_HEAD = r"""(?<![\p{L}\p{N}])(?i:password|passwd|pwd|passphrase|token|secret(?:[_\-]?key)?|(?:api|access|private)[_\-]?key)["']?\s{0,2}[=:]\s{0,2}["']?"""
SECRET = SECRET_HEAD + r"""(?=[_\-+/.]*+[A-Za-z0-9])[A-Za-z0-9_\-+/.]{6,}+"""
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
#: Three groups, the first in brackets or not; an area of two digits and four pairs; groups after a country code; a country code and digits.
PHONE = r"(?<![\w.])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|0\d(?:[ .\-]\d{2}){4}|\+(?=(?:[ .\-/()]{0,3}\d){8})\d{1,3}(?:[ .\-]?\(\d{1,4}\)[ .\-]?\d{1,8}|[ .\-/]\d{1,8}){2,6}|\+\d{8,15})(?!\d)"
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Don", "господин", "г-н")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Lady", "Doña", "Dra", "госпожа", "г-жа")
TITLES_N = ("Mx", "Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "доктор", "профессор")
#: Given names that introduce a full name without a title; those that are common words or places are left out.
KNOWN_M = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "Joshua", "Kevin", "Brian", "George", "Edward", "Ronald", "Timothy", "Jeffrey", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Günther", "Heinrich", "Friedrich", "Pierre", "Jacques", "Philippe", "François", "Michel", "Antoine", "Laurent", "Olivier", "José", "Juan", "Carlos", "Luis", "Miguel", "Javier", "Pedro", "Pablo", "Fernando", "Alejandro", "Иван", "Сергей", "Александр", "Дмитрий", "Алексей", "Николай", "Владимир", "Михаил")
KNOWN_F = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Margaret", "Nancy", "Emily", "Michelle", "Laura", "Helen", "Anna", "Maria", "Jane", "Julia", "Ursula", "Monika", "Petra", "Sabine", "Heike", "Ingrid", "Renate", "Marie", "Nathalie", "Isabelle", "Sophie", "Camille", "Céline", "Françoise", "Brigitte", "Carmen", "Isabel", "María", "Lucía", "Ana", "Teresa", "Pilar", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Екатерина")


def _any(words: tuple, shouted: bool = True) -> str:
    """One of the words, as written or in capitals."""
    return "|".join(sorted({*words, *([w.upper() for w in words if w not in ("Miss", "Ms", "Don")] if shouted else [])}, key=lambda t: (-len(t), t)))


TITLES = _any((*TITLES_M, *TITLES_F, *TITLES_N))
#: Titles (Herr Dr.), or words that present a name.
NAME_HEAD = rf"(?:(?:{TITLES})\.?(?: (?:{TITLES})\.?)* |M\. |(?i:my name is|ich heiße|mein name ist|je m['’]appelle|me llamo|mi nombre es|меня зовут) )"
NAME_WORD = r"\p{Lu}[\p{L}'’\-]+"
NAME_FIRST = r"(?:(?:\p{Lu}\.|von|van|der|den|de|del|la|di|da) )"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{NAME_HEAD}{NAME_FIRST}{{0,3}}{NAME_WORD}(?: {NAME_FIRST}{{0,3}}{NAME_WORD}){{0,2}}|(?=\p{{Lu}})(?:{_any(KNOWN_M + KNOWN_F)}) {NAME_FIRST}{{0,3}}{NAME_WORD}(?: {NAME_WORD})?)"

#: Kind and pattern; the first that fits an entity is its kind.
KINDS = (("email", EMAIL), ("secret", SECRET), ("access_key", ACCESS_KEY), ("iban", IBAN), ("ip", IP), ("ipv6", IPV6), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("name", NAME))
#: Kinds made of digits may stand after a letter; no other starts inside a word, which settles most positions of a text at once.
_DIGITS = ("ip", "ssn", "card")
ENTITY = "(?:(?<![A-Za-z0-9])(?:{})|(?=\\d)(?:{}))".format("|".join(p for k, p in KINDS if k not in _DIGITS and k != "phone"), "|".join(p for k, p in KINDS if k in _DIGITS)) + f"|(?=[+(\\d])(?:{PHONE})"

GIVEN_M = ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul")
GIVEN_F = ("Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Hanna", "Ines", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula")
GIVEN_M_CYR = ("Адам", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Леонид", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён")
GIVEN_F_CYR = ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья")
SYLLABLES = ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "zi", "lu")
SYLLABLES_CYR = ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "ве", "зи", "лу")
SECRET_PREFIX = rf"^(?:{SECRET_HEAD}|AKIA|ASIA)"
NAME_PREFIX = rf"^{NAME_HEAD}"
#: Hexadecimal secrets agree in either case.
UPPER_HEX = r"^(?=.*[A-F])[0-9A-F]{16,}$"
#: From this draw on a surrogate is longer by a syllable or digit each draw, so the space grows past any number of entities.
GROW = 8
#: Rows of the sample that looks for frequent texts.
SAMPLE_ROWS = 20_000


def kind_of(entity):
    out = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def prefix_of(kind, entity):
    """What stands before the part that is replaced: a title, or what introduces a secret."""
    return (
        F.when(kind.isin("secret", "access_key"), F.regexp_extract(entity, SECRET_PREFIX, 0))
        .when(kind == "name", F.regexp_extract(entity, NAME_PREFIX, 0))
        .otherwise("")
    )


def _ipv6_groups(text: str) -> str:
    """Eight groups without leading zeros, lower case."""
    left, right = (f"filter(split(coalesce(get(split(lower({text}), '::'), {i}), ''), ':'), g -> g <> '')" for i in (0, 1))
    return f"array_join(transform(concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right}), g -> regexp_replace(g, '^0+(?=.)', '')), ':')"


def canonical(kind, entity):
    """The form in which mentions of one entity agree."""
    core = F.substring(entity, F.length(prefix_of(kind, entity)) + 1, F.length(entity))
    starts = lambda c, words: F.regexp_like(c, F.lit(rf"^(?:{_any(words)})(?![\p{{L}}\p{{N}}])"))
    gender = F.when(starts(entity, TITLES_M + ("M.",)), "m:").when(starts(entity, TITLES_F), "f:").when(starts(core, KNOWN_M), "m:").when(starts(core, KNOWN_F), "f:").otherwise("n:")
    return (
        F.when(kind == "email", F.lower(core))
        .when(kind == "phone", F.concat(F.when(F.startswith(core, F.lit("+")), "+").otherwise(""), F.regexp_replace(core, r"\D", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(core, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(core, " ", ""))
        .when(kind == "name", F.concat(gender, F.initcap(core)))
        .when(kind == "ipv6", F.expr(_ipv6_groups("entity")))
        .when((kind == "secret") & F.regexp_like(core, F.lit(UPPER_HEX)), F.lower(core))
        .otherwise(core)
    )


#: What a phone number keeps: its country code (of one, two or three digits, as the numbering plan has it) or its leading 0.
PHONE_KEPT = "^(?:[+](?:[17]|2[07]|3[0-469]|4[^2]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|0)"


#: A keyed number for place i; `h` is the SHA-256 of key, kind, entity and draw.
def _at(h: str, i: str) -> str:
    return f"pmod(xxhash64({h}, {i}), 1048576)"


def _shape(text: str, h: str) -> str:
    """Letters to letters of the same case, digits to digits, the rest as it is. Long hexadecimal text stays hexadecimal."""
    return f"""array_join(transform(split({text}, ''), (c, i) -> CASE
        WHEN {text} RLIKE '^(?=.*[a-f])[0-9a-f]{{16,}}$' THEN substring('0123456789abcdef', cast({_at(h, 'i')} % 16 AS int) + 1, 1)
        WHEN c RLIKE '[0-9]' THEN cast({_at(h, 'i')} % 10 AS string)
        WHEN c RLIKE '[a-z]' THEN char(97 + {_at(h, 'i')} % 26)
        WHEN c RLIKE '[A-Z]' THEN char(65 + {_at(h, 'i')} % 26)
        ELSE c END), '')"""


def _digits(text: str, h: str) -> str:
    """As many digits, the first not 0."""
    return f"array_join(transform(split({text}, ''), (c, i) -> cast(CASE WHEN i = 0 THEN 1 + {_at(h, 'i')} % 9 ELSE {_at(h, 'i')} % 10 END AS string)), '')"


def _luhn(digits: str) -> str:
    """The digits with the last one replaced by the check digit of the others."""
    body = f"left({digits}, length({digits}) - 1)"
    total = f"""aggregate(transform(split(reverse({body}), ''), (c, i) -> CASE WHEN i % 2 = 1 THEN cast(c AS int)
        WHEN cast(c AS int) * 2 > 9 THEN cast(c AS int) * 2 - 9 ELSE cast(c AS int) * 2 END), 0, (a, x) -> a + x)"""
    return f"concat({body}, cast((10 - {total} % 10) % 10 AS string))"


def _iban(country: str, account: str) -> str:
    """Country, the two check digits that make the number 1 modulo 97, and account."""
    rest = f"""aggregate(split(concat({account}, {country}, '00'), ''), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + cast(c AS int)) % 97
        WHEN c RLIKE '[A-Z]' THEN (a * 100 + ascii(c) - 55) % 97 ELSE a END)"""
    return f"concat({country}, lpad(cast(98 - {rest} AS string), 2, '0'), {account})"


def _pick(words: tuple, h: str, i: str) -> str:
    items = ", ".join("'" + w + "'" for w in words)
    return f"element_at(array({items}), cast({_at(h, i)} % {len(words)} AS int) + 1)"


def _grown(piece: str) -> str:
    """A piece for each draw j from GROW on, nothing before it."""
    return f"CASE WHEN draw < {GROW} THEN '' ELSE array_join(transform(sequence({GROW}, draw), j -> {piece}), '') END"


def _name(h: str) -> str:
    """Gender, script and number of words as in the canonical form m:, f: or n: and name."""
    words = "split(substring(canon, 3), ' ')"
    latin, cyrillic = [f"concat(initcap({_pick(s, h, '101')}), {_pick(s, h, '102')}, {_pick(s, h, '103')}, {_pick(s, h, '104')}, {_grown(_pick(s, h, '200 + j'))}, {e})" for s, e in ((SYLLABLES, "'n'"), (SYLLABLES_CYR, "'н'"))]

    def given(m, f):
        return f"CASE WHEN canon LIKE 'm:%' OR (canon LIKE 'n:%' AND {_at(h, '7')} % 2 = 0) THEN {_pick(m, h, 'i')} ELSE {_pick(f, h, 'i')} END"

    return f"""array_join(transform({words}, (w, i) -> CASE
        WHEN i = size({words}) - 1 THEN CASE WHEN w RLIKE '[\\\\u0400-\\\\u04FF]' THEN {cyrillic} ELSE {latin} END
        ELSE CASE WHEN w RLIKE '[\\\\u0400-\\\\u04FF]' THEN {given(GIVEN_M_CYR, GIVEN_F_CYR)} ELSE {given(GIVEN_M, GIVEN_F)} END END), ' ')"""


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate``, the canonical surrogate of (kind, canon) at ``draw``."""
    with_key = entities.withColumn("h", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon", F.col("draw").cast("string")), 256))
    domain = "concat('mail', substring(sha2(concat('{k}', split(canon, '@')[1]), 256), 1, 8), '.example.', element_at(array('com', 'net', 'org'), cast(pmod(xxhash64(canon), 3) AS int) + 1))"
    domain = domain.replace("{k}", key.replace("'", ""))
    more = _grown(f"cast({_at('h', '200 + j')} % 10 AS string)")
    out = f"""CASE kind
        WHEN 'email' THEN concat({_shape("split(canon, '@')[0]", 'h')}, {more}, '@', {domain})
        WHEN 'card' THEN {_luhn(f"concat({_digits('canon', 'h')}, {more})")}
        WHEN 'phone' THEN concat(regexp_extract(canon, '{PHONE_KEPT}', 0), {_digits("substring(canon, length(regexp_extract(canon, '" + PHONE_KEPT + "', 0)) + 1)", 'h')}, {more})
        WHEN 'ssn' THEN concat({_digits('canon', 'h')}, {more})
        WHEN 'ip' THEN CASE WHEN draw < {GROW} THEN concat_ws('.', 10, {_at('h', '1')} % 256, {_at('h', '2')} % 256, 1 + {_at('h', '3')} % 254)
            ELSE concat('2001:db8:4:', array_join(transform(sequence(0, 4), i -> lower(hex({_at('h', 'i')} % 65536))), ':')) END
        WHEN 'ipv6' THEN concat('2001:db8:6:', array_join(transform(sequence(0, 4), i -> lower(hex({_at('h', 'i')} % 65536))), ':'))
        WHEN 'name' THEN concat(left(canon, 2), {_name('h')})
        WHEN 'iban' THEN {_iban('left(canon, 2)', f"concat({_shape('substring(canon, 5)', 'h')}, {more})")}
        ELSE concat({_shape('canon', 'h')}, {more}) END"""
    return with_key.withColumn("surrogate", F.expr(out)).drop("h")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, canon) to (kind, canon, surrogate), one to one and apart from all real entities."""
    taken, todo, done = materialise(entities.select("kind", "canon")), None, None
    todo = taken.withColumn("draw", F.lit(0))
    for draw in count():
        now = drawn(todo, key)
        others = taken.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        if done is not None:
            others = others.unionByName(done.select("kind", "surrogate", F.lit(True).alias("real")))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        judged = now.join(others.distinct(), ["kind", "surrogate"], "left").withColumn("ok", (rank == 1) & F.col("real").isNull())
        judged = materialise(judged.select("kind", "canon", "surrogate", "ok"))
        good = judged.where("ok").select("kind", "canon", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = judged.where("NOT ok").select("kind", "canon", F.lit(draw + 1).alias("draw"))
        if todo.isEmpty():
            return done


def told_names(names: DataFrame) -> DataFrame:
    """(canon, told): names of untold gender and the one form of told gender that other mentions of the name agree on."""
    by_name = names.select(F.substring("canon", 3, 1 << 30).alias("name"), F.left("canon", F.lit(2)).alias("g"))
    by_name = by_name.groupBy("name").agg(*[F.bool_or(F.col("g") == f"{g}:").alias(g) for g in "mfn"]).where("n AND m <> f")
    return by_name.select(F.concat(F.lit("n:"), "name").alias("canon"), F.concat(F.when(F.col("m"), "m:").otherwise("f:"), "name").alias("told"))


def rendered():
    """The surrogate in the mention's own format: prefix, punctuation, title."""
    filled = """aggregate(split(entity, ''), named_struct('out', '', 'n', 0), (a, c) -> CASE WHEN c RLIKE '[0-9]'
        THEN named_struct('out', concat(a.out, substring(digits, a.n + 1, 1)), 'n', a.n + 1) ELSE named_struct('out', concat(a.out, c), 'n', a.n) END, a -> concat(a.out, substring(digits, a.n + 1)))""".replace("digits", "ltrim('+', surrogate)")
    spaced = """aggregate(split(entity, ''), named_struct('out', '', 'n', 0), (a, c) -> CASE WHEN c <> ' '
        THEN named_struct('out', concat(a.out, substring(surrogate, a.n + 1, 1)), 'n', a.n + 1) ELSE named_struct('out', concat(a.out, c), 'n', a.n) END, a -> concat(a.out, substring(surrogate, a.n + 1)))"""
    return F.expr(f"""CASE WHEN kind IN ('card', 'phone', 'ssn') THEN {filled} WHEN kind = 'iban' THEN {spaced}
        WHEN kind IN ('ip', 'ipv6') THEN surrogate
        WHEN kind = 'name' THEN concat(prefix, CASE WHEN core = upper(core) THEN upper(substring(surrogate, 3)) ELSE substring(surrogate, 3) END)
        WHEN kind = 'secret' AND core RLIKE '{UPPER_HEX}' THEN concat(prefix, upper(surrogate)) ELSE concat(prefix, surrogate) END""")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input's columns with ``text_col`` rewritten, plus n_entities."""
    docs = docs.drop("n_entities")
    kept = docs.columns
    text = F.col(text_col).cast("string")
    digest = F.md5(F.encode(text, "UTF-8"))
    found = docs.select(digest.alias("digest"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found")).where(F.size("found") > 0)
    found = found.groupBy("digest").agg(F.first("found").alias("found"))
    mentions = found.select("digest", F.posexplode("found").alias("pos", "entity")).withColumn("kind", kind_of(F.col("entity")))
    mentions = materialise(mentions.withColumns({"prefix": prefix_of(F.col("kind"), F.col("entity")), "canon": canonical(F.col("kind"), F.col("entity"))}))
    entities = materialise(mentions.select("kind", "canon").distinct())
    told = materialise(told_names(entities.where("kind = 'name'")))
    untold = told.select(F.lit("name").alias("kind"), "canon")
    table = materialise(surrogates(entities.join(untold, ["kind", "canon"], "left_anti"), key))
    names = table.where("kind = 'name'").select(F.col("canon").alias("told"), "surrogate")
    table = table.unionByName(told.join(names, "told").select(F.lit("name").alias("kind"), "canon", "surrogate"))
    core = mentions.withColumn("core", F.expr("substring(entity, length(prefix) + 1)"))
    new = even_join(core, table, ["kind", "canon"], ["digest", "pos"]).withColumn("new", rendered())
    per_text = materialise(new.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("__pii_new")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent_values(docs, F.coalesce(digest, F.lit("")), parts, SAMPLE_ROWS)
    others = [c for c, kind in docs.dtypes if c.lower() != text_col.lower() and kind in ("bigint", "int", "string", "double", "date", "timestamp")]
    is_hot = lambda c: F.coalesce(c, F.lit("")).isin(hot) if hot else F.lit(False)
    src = docs.withColumn("__pii", digest).withColumn("__salt", F.when(is_hot(F.col("__pii")), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0).cast("long"), F.lit(parts))).otherwise(0))
    salts = F.when(is_hot(F.col("__pii")), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    per_text = per_text.withColumnRenamed("digest", "__pii").withColumn("__salt", F.explode(salts))
    # Replacements grow with the texts: joined by a shuffle at every size.
    both = src.join(per_text.hint("merge"), ["__pii", "__salt"], "left")
    pieces = F.split(text, ENTITY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, F.col("__pii_new.new"), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))))
    return both.withColumn(text_col, F.when(F.col("__pii_new").isNotNull(), joined).otherwise(text)).select(*kept, F.coalesce(F.size("__pii_new"), F.lit(0)).cast("long").alias("n_entities")).withColumn("n_entities", F.greatest("n_entities", F.lit(0).cast("long")))
