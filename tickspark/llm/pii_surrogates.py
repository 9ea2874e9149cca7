"""Surrogates for personal data, with DataFrame functions only.

Mentions found by pattern are brought to a canonical form; each distinct (type, canonical form) draws a keyed
replacement of the same type and format: cards pass the Luhn test, account numbers mod 97, social-security numbers have
valid parts, names and letters keep gender, script and case.  A draw that equals another entity's replacement or any
entity that occurs is drawn again, longer after some lost rounds, so replacements are distinct, never real, and no
format is ever full.  All mentions of an entity, in any notation, show the one replacement in the mention's own notation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, join_hot, materialise, whole_text

# First names whose replacement keeps gender and script, and titles before names.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Claire Elena Emma Julia Laura Linda Maria Marie Mary Nina Patricia Sarah Sofia Susan Teresa",
    ("m", "latin"): "Andreas Carlos Daniel David Hans James Jean John Juan Karl Luis Mark Michael Paul Peter Pierre Robert Thomas",
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Наталья Ольга Татьяна",
    ("m", "cyrillic"): "Александр Андрей Борис Виктор Дмитрий Иван Михаил Сергей",
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία",
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος",
}
TITLES = "MR MRS MS DR PROF Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Monsieur Madame Mme Don Doña Sra Sr Г-н Г-жа Κύριος Κυρία"
# What stands before a name without a title.
CUES = ("my name is", "name:", "signed by", "regards,", "sincerely,", "je m'appelle", "mein Name ist", "ich heiße", "me llamo", "mi nombre es", "меня зовут", "με λένε")
# Vowels and consonants of scripts with case, letters of scripts without.
LETTERS = {
    "Latin": ("aeiou", "bcdfghjklmnprstvwz"),
    "Cyrillic": ("аеиоуя", "бвгдзклмнпрстфхчш"),
    "Greek": ("αεηιουω", "βγδθκλμνπρστφχψ"),
    "Armenian": ("աեիու", "բգդզթլկհմնպսվտր"),
}
PLAIN_LETTERS = {
    "Han": "安白成大东方高国海和江金林明平青山石天文",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてと",
    "Katakana": "アイウエオカキクケコサシスセソタチツテト",
    "Hangul": "가나다라마바사아자하고노도로모보소오조호",
    "Hebrew": "אבגדהוזחטילמנסעפקרשת",
    "Arabic": "ابتثجحدرزسشصطعفقلمنه",
    "Devanagari": "कखगघचछजटडतथदनपबमरलसह",
    "Thai": "กขคงจชซดตถทนบปพมยรลส",
    "Georgian": "აბგდევზთიკლმნოპრსტუფ",
}
_VOWEL = "[aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýÿаеёиоуыэюяіїєαεηιουωάέήίόύώաեէըիոօ]"
#: A name with an inner capital or apostrophe (McDonald, O'Brien), or of two parts with a hyphen; one in capitals.
_NAME = r"\p{Lu}(?:\p{Ll}{0,3}['’]?\p{Lu})?\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
_CAPITALS = r"\p{Lu}[\p{Lu}'’-]{1,30}"
_HEX = "[0-9a-fA-F]{1,4}"
#: Prefixes that mark access keys.
KEY_PREFIX = "AKIA|gh[pousr]_|sk-|xox[baprs]-|AIza"
_FIRST = "|".join(n for v in FIRST_NAMES.values() for n in v.split())
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+@-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?=[0-9a-fA-F]{8})(?<![A-Za-z0-9])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![A-Za-z0-9])",
    "key": rf"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}}|xox[baprs]-[A-Za-z0-9-]{{10,60}}|AIza[A-Za-z0-9_-]{{35}})(?![A-Za-z0-9_-])",
    "card": r"(?=[0-9]{4}|[Cc]ard|CARD)(?<![\w.-])(?:(?:[Cc]ard|CARD)(?: number| no\.?)?:? )?(?:[0-9]{16}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|4[0-9]{12}|3[0689][0-9]{12}|3[47][0-9]{13}|(?:4|5[0678]|6)[0-9]{16,18}|3[47][0-9]{2} [0-9]{6} [0-9]{5}|3[47][0-9]{2}-[0-9]{6}-[0-9]{5})(?![\w-])",
    "ip": r"(?=[0-9]{1,3}\.)(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])",
    "ip6": rf"(?<![\w:])(?:[23][0-9a-fA-F]{{3}}|[fF][eE]80|[fF][cCdD][0-9a-fA-F]{{2}})(?:(?::{_HEX}){{7}}|(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "phone": r"(?=[0-9+(])(?<![\w+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}|\+[1-9](?:[ .-]?[0-9]){7,14})(?![\w-])",
    "ssn": r"(?=[0-9]{3}-)(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES.split())})\.? (?:{_NAME}(?: {_NAME}){{0,2}}|{_CAPITALS}(?: {_CAPITALS}){{0,2}})|(?:{_FIRST}) {_NAME}(?: {_NAME})?|(?<=(?:{'|'.join(CUES)})\s){_NAME} {_NAME})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has, so that other texts are passed over quickly.
HINT = (
    rf"[@]|[0-9](?:[0-9]{{2}}|\.[0-9])|\+[1-9]|[0-9a-fA-F]{{16}}|[fF][eEcCdD][0-9a-fA-F]{{2}}:|(?:{KEY_PREFIX})[A-Za-z0-9]"
    rf"|(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(TITLES.split())}|{_FIRST})[. ]|(?:{'|'.join(CUES)})\s"
)


def mentions(text: Column) -> Column:
    """All entity mentions of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def mention_type(mention: Column) -> Column:
    return reduce(lambda c, k: c.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), k), list(PATTERNS)[1:-1], F.when(mention.rlike(f"^(?:{PATTERNS['email']})$"), "email")).otherwise("name")


def valid(kind: Column, mention: Column, canon: Column) -> Column:
    """Whether a mention is what its pattern says: check digits decide for account numbers, and for cards that the text does not call so."""
    card = mention.rlike("^[A-Za-z]") | (luhn_digit(F.substr(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1))
    account = mod97_digits(F.substring(canon, 1, 2), F.substr(canon, F.lit(5))) == F.substring(canon, 3, 2)
    return F.when(kind == "card", card).when(kind == "iban", account).otherwise(F.lit(True))


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all notations: digits of numbers, account numbers without spaces, lower case of e-mail addresses, IPv6 addresses and hex secrets."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "secret", "ip6"), F.lower(mention))
        .otherwise(mention)
    )


def _digit_at(h: Column, i: Column, n: int) -> Column:
    """A keyed number below n for character i, from a string of 128 hex digits."""
    return F.pmod(F.conv(F.substr(h, F.pmod(i * 5, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("long") + i, F.lit(n))


def _letter(alphabet: str, h: Column, i: Column) -> Column:
    return F.substr(F.lit(alphabet), (_digit_at(h, i, len(alphabet)) + 1).cast("int"), F.lit(1))


def _respell(text: Column, h: Column, name: bool = False) -> Column:
    """Each letter to a keyed one of its script and case, each digit to a digit; other characters stay.

    Letters keep their vowel class; in names vowels and consonants take turns.  A letter of a script without a list becomes a Latin one.
    """

    def one(c: Column, i: Column) -> Column:
        vowel = F.pmod(i, F.lit(2)) == 1 if name else F.lower(c).rlike(_VOWEL)
        out = F.when(c.rlike("[0-9]"), _digit_at(h, i, 10).cast("string")).when(~c.rlike(r"\p{L}"), c)
        for script, letters in PLAIN_LETTERS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), _letter(letters, h, i))
        low = None
        for script, (vowels, consonants) in reversed(LETTERS.items()):
            new = F.when(vowel, _letter(vowels, h, i)).otherwise(_letter(consonants, h, i))
            low = new if script == "Armenian" else F.when(c.rlike(rf"\p{{Is{script}}}"), new).otherwise(low)
        low = F.when(c.rlike("|".join(rf"\p{{Is{x}}}" for x in LETTERS)), low).otherwise(F.when(vowel, _letter("aeiou", h, i)).otherwise(_letter("bcdfghjklmnprstvwz", h, i)))
        return out.otherwise(F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _below(h: Column, at: int, n: int, low: int = 0) -> Column:
    return F.pmod(F.conv(F.substring(h, at, 8), 16, 10).cast("long"), F.lit(n)) + low


def luhn_digit(digits: Column) -> Column:
    """The digit that makes the digits pass the Luhn test when it follows them."""
    twice = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), twice), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def mod97_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


#: Rounds after which a draw gets longer, by one character in every further round.
PATIENCE = 6


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of a canonical form at the given attempt; late attempts are longer, so that there is always one more."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"))
    h = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))
    more = F.greatest(attempt - PATIENCE, F.lit(0))
    # letters added to names and local parts, digits added to numbers
    letters = F.substr(F.translate(F.sha2(F.concat(seed, F.lit("more")), 256), "0123456789abcdef", "aeioubdgklmnrstv"), F.lit(1), more)
    numbers = F.substr(F.translate(F.sha2(F.concat(seed, F.lit("more")), 256), "abcdef", "012345"), F.lit(1), more)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"([^.]+)$", 1)
    host_hash = F.concat(*(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(x), domain), 256) for x in ("domain", "domain+")))
    octets = F.concat_ws(".", *(_below(h, 1 + 8 * k, n, low) for k, (low, n) in enumerate([(1, 223), (0, 256), (0, 256), (1, 254)])))
    hexes = F.substr(F.concat(h, h), F.lit(1), F.length(canon))
    ip6 = F.concat(F.lit("2001"), F.array_join(F.transform(F.split(F.substr(canon, F.lit(5)), ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.conv(_digit_at(h, i, 16).cast("string"), 10, 16)).otherwise(c)), ""))
    whole6 = F.concat(F.lit("2001"), *(F.concat(F.lit(":"), F.substring(h, 1 + 4 * k, 4)) for k in range(7)))
    body = F.concat(F.substring(canon, 1, 1), _respell(F.substr(canon, F.lit(2), F.length(canon) - 2), h), numbers)
    account = F.concat(_respell(F.substr(canon, F.lit(5)), h), numbers)
    prefix = F.regexp_extract(canon, f"^({KEY_PREFIX})", 1)
    ssn = F.concat(F.lpad(_below(h, 1, 665, 1).cast("string"), 3, "0"), F.lpad(_below(h, 9, 99, 1).cast("string"), 2, "0"), F.lpad(_below(h, 17, 9999, 1).cast("string"), 4, "0"), numbers)
    keep = F.greatest(F.length(canon) - 10, F.lit(0))
    return (
        F.when(kind == "email", F.concat(_respell(local, h), letters, F.lit("@"), _respell(host, host_hash), F.lit("."), top))
        .when(kind == "ip", F.when(more > 3, whole6).otherwise(octets))
        .when(kind == "ip6", F.lower(F.when(more > 0, whole6).otherwise(ip6)))
        .when(kind == "secret", F.concat(hexes, F.substr(h, F.lit(1), more)))
        .when(kind == "key", F.concat(prefix, _respell(F.substr(canon, F.length(prefix) + 1), h), letters))
        .when(kind == "card", F.concat(body, luhn_digit(body)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), mod97_digits(F.substring(canon, 1, 2), account), account))
        .when(kind == "phone", F.concat(F.substr(canon, F.lit(1), keep), _respell(F.substr(canon, keep + 1), h), numbers))
        .when(kind == "ssn", ssn)
        .otherwise(F.concat(_respell(canon, h, name=True), letters))
    )


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The replacement in the notation of the mention; what a longer one has more comes at the end."""

    def placed(other: str) -> Column:
        at = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), (i + 1).cast("int")), other, ""))
        shown = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(~c.rlike(other), F.substr(surrogate, at(i), F.lit(1))).otherwise(c)), "")
        return F.concat(shown, F.substr(surrogate, F.length(F.regexp_replace(mention, other, "")) + 1))

    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "phone", "ssn"), placed("[^0-9]")).when(kind == "iban", placed("[^A-Z0-9]")).when(kind.isin("email", "secret", "ip6"), cased).otherwise(surrogate)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon) distinct -> (kind, canon, surrogate), distinct within a kind and unlike any canon of it.

    In each round the entities still open draw again; a draw is lost if it is an entity itself, was
    given before, or if a smaller canon drew it too.  Draws get longer after PATIENCE rounds, so that the rounds end.
    """
    real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(0).alias("turn"), F.lit("").alias("canon"))
    given, waiting, turn = None, entities.select("kind", "canon"), 0
    while given is None or not waiting.isEmpty():
        turn += 1
        drawn = waiting.select("kind", draw(F.col("kind"), F.col("canon"), F.lit(turn), key).alias("surrogate"), F.lit(turn).alias("turn"), "canon")
        claims = drawn.unionByName(real) if given is None else drawn.unionByName(real).unionByName(given)
        first = claims.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "canon")).alias("won"))
        given = checkpoint(first.filter("won.turn > 0").select("kind", "surrogate", F.col("won.turn").alias("turn"), F.col("won.canon").alias("canon")))
        waiting = checkpoint(entities.select("kind", "canon").join(given.select("kind", "canon"), ["kind", "canon"], "left_anti"))
    return given.select("kind", "canon", "surrogate")


def _names(mention: Column) -> tuple[Column, Column, Column]:
    """(title part, first name, what follows it) of a name mention."""
    title = F.regexp_extract(mention, rf"^((?:{'|'.join(TITLES.split())})\.? )", 1)
    rest = F.substr(mention, F.length(title) + 1)
    first = F.when(rest.contains(" "), F.substring_index(rest, " ", 1)).otherwise("")
    return title, first, F.when(first == "", rest).otherwise(F.substr(rest, F.length(first) + 2))


def _first_name(name: Column, key: str) -> Column:
    """A first name of the same gender and script: the keyed rotation of its list; unlisted ones are respelled."""
    out = None
    for (gender, script), listed in FIRST_NAMES.items():
        names = listed.split()
        shift = F.pmod(F.xxhash64(F.lit(key), F.lit(gender + script)), F.lit(len(names) - 1)) + 1
        hit = name.isin(*names)
        at = F.pmod(F.array_position(F.array(*map(F.lit, names)), name) - 1 + shift, F.lit(len(names))) + 1
        new = F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    h = F.concat(F.sha2(F.concat(F.lit(key), F.lit("first"), name), 256), F.sha2(F.concat(F.lit(key), F.lit("first+"), name), 256))
    return out.otherwise(_respell(name, h, name=True))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", details: bool = False) -> DataFrame:
    """The rows with every entity in the text replaced; details adds n_entities (long) and the array kinds.

    Null and empty texts stay as they are.  Equal texts get equal replacements; repeated rows and null ids stay.  Columns named
    n_entities and kinds are replaced if details are asked for; all others stay.  Account numbers count only if
    their check digits are right, cards if they are or if the text calls them cards.  Texts of any length are taken whole; those with mentions are searched for them once and
    split at them once.  A name is found after a title, as a listed first name with what follows, or after a cue.
    """
    if details:
        docs = docs.drop("n_entities", "kinds")
    names = docs.columns
    text = F.col(f"row.`{text_col}`")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    found = boxed.withColumn("found", mentions(whole_text(text)))
    found = materialise(found.withColumn("k", F.when(F.size("found") > 0, F.sha2(text, 256))), "mentions")
    hit = found.filter("k is not null")
    by_rows = hit.groupBy("k").agg(F.count("*").alias("n"), F.first("found").alias("found"))
    listed = by_rows.select("k", "n", F.posexplode("found").alias("pos", "mention")).withColumn("kind", mention_type(F.col("mention")))
    # the parts of names are stored as columns, as the expressions of replacements name them many times
    title, first, last = _names(F.col("mention"))
    listed = listed.withColumns({"title": title, "first": first, "last": last})
    listed = listed.withColumn("capitals", (F.upper("last") == F.col("last")) & (F.lower("last") != F.col("last")) & (F.length("last") > 1))
    plain_case = lambda name: F.when(F.col("capitals"), F.initcap(F.lower(name))).otherwise(F.col(name))
    canon = F.when(F.col("kind") == "name", plain_case("last")).otherwise(canonical(F.col("kind"), F.col("mention")))
    listed = materialise(listed.withColumns({"canon": canon, "first": plain_case("first")}).drop("last"), "typed")
    listed = materialise(listed.withColumn("kind", F.when(valid(F.col("kind"), F.col("mention"), F.col("canon")), F.col("kind"))), "entities")
    given = assign(listed.filter("kind is not null").select("kind", "canon").distinct(), key)
    called = F.concat(F.when(F.col("first") == "", "").otherwise(F.concat(_first_name(F.col("first"), key), F.lit(" "))), F.col("surrogate"))
    called = F.concat(F.col("title"), F.when(F.col("capitals"), F.upper(called)).otherwise(called))
    new = F.when(F.col("kind") == "name", called).otherwise(render(F.col("kind"), F.col("mention"), F.col("surrogate")))
    # a number that fails its check digits stays as it is
    new = F.when(F.col("kind").isNull(), F.col("mention")).otherwise(new)
    done = listed.join(given, ["kind", "canon"], "left").select("k", "n", F.struct("pos", new.alias("new"), "kind").alias("x"))
    by_text = materialise(done.groupBy("k").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("x")).alias("x")), "replacements")
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col("x.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = join_hot(hit, by_text, "k", "n").select("row", joined.alias("text"), F.array_compact("x.kind").alias("kinds"))
    plain = found.filter("k is null").select("row", text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    both = changed.unionByName(plain)
    out = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    if details:
        out += [F.size("kinds").cast("long").alias("n_entities"), F.col("kinds")]
    return both.select(*out)
