"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same wherever the entity recurs.

Entities are found by pattern and brought to a canonical value, so that mentions of one entity in
different formats agree. The table of distinct entities gets a surrogate for each: a keyed hash
fills the entity's slots (digits by digits, letters by letters of the same script and case; names
by names of the same gender and script; country codes, honorifics and separators stay). Surrogates
are checked against each other and against the real values; whoever collides draws again, the rest
stay, until none does. Values that are valid by check digits (cards, IBANs) stay valid. Mentions
then take their entity's surrogate in their own format.

A person is found after an honorific; the same name, or the family name alone, is then found without
one wherever else the document has it.

The text is searched once, and once more where it names persons; after that only mentions and entities move, and each text once to meet
its surrogates. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.common import discard, materialize, row_key, table

#: The key of this repository's own queries; a real corpus takes a secret one.
KEY = "scholion"
#: Draws after which entities without a value are dealt each other's.
ATTEMPTS = 10

# Honorifics by gender, given names by gender and script, and syllables by script.
_MALE = "Mr|Herrn|Herr|Monsieur|Señor|Господин|господин|г-н|Κύριος|κύριος|Κύριο|κύριο|Κος|κος"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа|госпожа|г-жа|Κυρία|κυρία|Κα|κα"
_GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Daniel Emil Felix Hugo Julian Leon Martin Oscar Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Helena Julia Laura Marta Olivia Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Леонид Максим Павел Роман".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Σοφία".split(),
    ("cyrillic", "f"): "Алина Вера Дарья Елена Зоя Инна Ксения Лидия Марина Нина Ольга Раиса".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da del di fa fen ga gor hal jo ka kel lan lo mar mi nel no par pe ral ro sa sen tal ti var vin wel zan".split(),
    "cyrillic": "ба бе бо да дел ди фа фен га гор хал жо ка кел лан ло мар ми нел но пар пе рал ро са сен тал ти вар вин вел зан".split(),
    "greek": "βα βε βο δα δελ δι φα φεν γα γορ χαλ κα κελ λαν λο μαρ μι νελ νο παρ πε ραλ ρο σα σεν ταλ τι θαν θε ξεν ζα ζο".split(),
}
_LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![\p{L}\p{N}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Of a number with a plus sign seven digits are asked, else signed amounts would be taken for phones.
PHONE = r"(?<![\p{L}\p{N}+])(?:\+(?=(?:[ .()-]{0,3}[0-9]){7})[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_FEMALE}|{_MALE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"
_HONORIFIC = rf"^(?:{_FEMALE}|{_MALE})\.? "
#: The shortest form of a name that is looked for without an honorific.
NAME_LETTERS = 3
#: In order of preference where several match at one place.
PATTERNS = {"email": EMAIL, "iban": IBAN, "ip": IP, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
PATTERN = "|".join(PATTERNS.values())
#: Every match has one of these, and finding them is cheap.
_HINT = rf"[@0-9]|{_FEMALE}|{_MALE}"


def _hash(*parts: Column | str | int) -> Column:
    return F.xxhash64(*(x if isinstance(x, Column) else F.lit(x) for x in parts))


def _one_of(words: list[str] | str, seed: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(seed, F.lit(len(words))).cast("int"))


def _each_of(words: list[str], seeds: Column) -> Column:
    return F.transform(seeds, lambda x: _one_of(words, x))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: F.length(c) > 0)


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def parts_of(found: Column) -> Column:
    """``array<struct<kind, canon>>``: the entities that a mention names; two for a given and a family name, else one."""
    slots = F.regexp_replace(found, "[^0-9A-Za-z]", "")
    code = F.regexp_extract(found, r"^\+([0-9]{1,3})[ .(-]", 1)
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit(" "), F.substr(slots, F.length(code) + 1))).otherwise(slots)
    gender = F.when(found.rlike(f"^(?:{_FEMALE})\\b"), "f").otherwise("m")
    words = F.split(F.regexp_extract(found, rf"^(?:{_FEMALE}|{_MALE})\.? (.*)$", 1), " ")
    family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
    given = F.struct(F.concat(F.lit("given_"), gender).alias("kind"), F.lower(F.element_at(words, 1)).alias("canon"))
    out = F.when(found.rlike(f"^(?:{NAME})$"), F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family)))
    canon = {"email": F.lower(found), "ip": found, "phone": phone}
    for kind in ("phone", "ssn", "card", "ip", "iban", "email"):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), F.array(F.struct(F.lit(kind).alias("kind"), canon.get(kind, slots).alias("canon")))).otherwise(out)
    return out


def _filled(value: Column, seed: Column) -> Column:
    """Each letter and digit by another of its kind, from the keyed seed; zero may become any digit, others stay above zero."""

    def fill(c: Column, k: Column) -> Column:
        draw = _hash(seed, k)
        out = F.when(c == "0", F.pmod(draw, F.lit(10)).cast("string")).when(c.rlike("[1-9]"), (F.pmod(draw, F.lit(9)) + 1).cast("string"))
        for script, letters in _LETTERS.items():
            test = c.rlike(r"\p{L}") & (_script(c) == script)
            out = out.when(test & c.rlike(r"\p{Lu}"), _one_of(letters.upper(), draw)).when(test, _one_of(letters, draw))
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(value), fill), "")


def _luhn_sum(digits: Column) -> Column:
    def worth(c: Column, k: Column) -> Column:
        n = c.cast("int")
        return F.when(k % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.reverse(_chars(digits)), worth), F.lit(0), lambda a, b: a + b)


def _mod97(chars: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, whose letters count from 10 on."""
    return F.aggregate(_chars(chars), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _iban_valid(canon: Column) -> Column:
    return _mod97(F.concat(F.substring(canon, 5, 1 << 20), F.substring(canon, 1, 4))) == 1


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate that an entity draws at an attempt."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)
    filled = _filled(canon, seed)
    short = F.concat(F.substr(filled, F.lit(1), F.length(filled) - 1), F.lit("0"))
    checked = F.concat(F.substr(filled, F.lit(1), F.length(filled) - 1), F.pmod(-_luhn_sum(short), F.lit(10)).cast("string"))
    card = F.when(_luhn_sum(canon) % 10 == 0, checked).otherwise(filled)
    domain = F.substring_index(canon, "@", -1)
    label = F.lower(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 10), 16, 36))
    local = F.regexp_replace(_filled(F.substring_index(canon, "@", 1), seed), "^[.]+", "x")
    email = F.concat(F.when(attempt > 8, F.concat(local, attempt.cast("string"))).otherwise(local), F.lit("@"), F.lit("m"), label, F.lit(".example."), F.substring_index(domain, ".", -1))
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda k: (F.pmod(_hash(seed, k), F.lit(254)) + 1).cast("string")), ".")
    phone = F.when(canon.startswith("+"), F.concat(F.regexp_extract(canon, r"^(\+[0-9]+ )", 1), _filled(F.regexp_extract(canon, " (.*)$", 1), seed))).otherwise(filled)
    account, country = _filled(F.substring(canon, 5, 1 << 20), seed), F.substring(canon, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_iban_valid(canon), check).otherwise(_filled(F.substring(canon, 3, 2), _hash(seed, "check"))), account)

    def syllables(n: Column) -> Column:
        made = F.lit(None).cast("string")
        for script, known in _SYLLABLES.items():
            drawn = F.transform(F.sequence(F.lit(1), n), lambda k: _hash(seed, k))
            made = F.when(_script(canon) == script, F.array_join(_each_of(known, drawn), "")).otherwise(made)
        return F.initcap(made)

    given = syllables(F.lit(3) + attempt.cast("int"))
    for (script, gender), names in _GIVEN.items():
        first, second = _one_of(names, _hash(seed, 1)), _one_of(names, _hash(seed, 2))
        listed = F.when(attempt == 0, first).when(attempt < 4, F.concat(first, F.lit("-"), second)).otherwise(F.concat(first, F.lit("-"), given))
        given = F.when((_script(canon) == script) & (kind == f"given_{gender}"), listed).otherwise(given)
    out = F.when(kind == "family", syllables(F.lit(3) + F.floor(attempt / 2).cast("int"))).when(kind.startswith("given_"), given)
    for name, made in (("email", email), ("ip", ip), ("phone", phone), ("iban", iban), ("card", card)):
        out = out.when(kind == name, made)
    return out.otherwise(filled)


def _shape(kind: Column, canon: Column) -> Column:
    """Entities of one shape draw from the same values, and from no others; null where values grow with attempts and so never run out."""
    digits = F.regexp_replace(canon, "[0-9]", "9")
    phone = F.concat(F.regexp_extract(canon, r"^(\+[0-9]+ )", 1), F.regexp_replace(F.regexp_replace(canon, r"^\+[0-9]+ ", ""), "[0-9]", "9"))
    iban = F.concat(F.substring(canon, 1, 2), F.regexp_replace(F.substring(digits, 3, 1 << 20), "[A-Z]", "A"), _iban_valid(canon).cast("string"))
    out = F.when(kind == "ip", "").when(kind == "phone", phone).when(kind == "iban", iban)
    return out.when(kind == "card", F.concat(digits, (_luhn_sum(canon) % 10 == 0).cast("string"))).when(kind == "ssn", digits)


def _permuted(drawn: DataFrame, key: str) -> DataFrame:
    """``drawn`` with the values of those that found none dealt among them, by a keyed cycle over each shape.

    No settled core is a real value, so these are free, and none meets its own. One that is alone
    shares the cycle of all entities of its shape; alone there too, it draws on.
    """
    open_ = ~F.col("settled") & F.col("shape").isNotNull()
    shaped = drawn.withColumn("shape", _shape(F.col("kind"), F.col("canon")))
    counts = shaped.filter(open_).groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"))
    joined = shaped.join(counts, ["kind", "shape"], "left").withColumn("dealt", F.col("n").isNotNull() & (~F.col("settled") | (F.col("n") == 1)))
    dealt = joined.filter("dealt")
    cycle = Window.partitionBy("kind", "shape").orderBy(_hash(key, F.col("canon")), "canon")
    whole = cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = dealt.withColumn("core", F.coalesce(F.lead("canon").over(cycle), F.first("canon").over(whole)))
    dealt = dealt.withColumn("settled", F.col("core") != F.col("canon"))
    columns = ["kind", "canon", "attempt", "settled", "core"]
    return joined.filter(~F.col("dealt")).select(columns).union(dealt.select(columns))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(``kind``, ``canon``, ``core``) for each distinct entity; cores of a kind are distinct and no entity's own value.

    Those of least canonical value keep what they drew, of any that collide; the others draw again.
    Where a kind's values are used up, so that some have none after ten attempts, their real values
    are dealt among them, each to another. Else no core is a real value.
    """
    drawn = entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("settled", F.lit(False))
    drawn, tries, last = drawn.withColumn("core", F.lit(None).cast("string")), 0, None
    while True:
        again = F.when(F.col("settled"), F.col("core")).otherwise(surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        before, drawn = last, materialize(drawn.withColumn("core", again), "surrogates")
        last = drawn
        if before is not None:
            discard(before)
        holders = drawn.groupBy("kind", "core").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(~F.col("settled"), "canon")).alias("holder"))
        clashing = holders.filter("n > 1").select("kind", "core", F.col("holder.canon").alias("holder"))
        real = drawn.select("kind", F.lower("canon").alias("value"), F.lit(True).alias("real")).distinct()
        met = drawn.withColumn("value", F.lower("core")).join(clashing, ["kind", "core"], "left").join(real, ["kind", "value"], "left")
        again = ~F.col("settled") & (F.coalesce(F.col("holder") != F.col("canon"), F.lit(False)) | F.col("real").isNotNull())
        judged = met.select("kind", "canon", "attempt", "core", again.alias("again"))
        if judged.filter("again").isEmpty():
            return drawn.select("kind", "canon", "core")
        drawn = judged.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), (~F.col("again")).alias("settled"), "core")
        tries += 1
        if tries == ATTEMPTS:
            drawn = _permuted(drawn, key)


def _in_format(found: Column, cores: Column) -> Column:
    """A mention with its entities' cores in the mention's own format. ``cores`` holds ``kind`` and ``core`` in order."""
    first = F.get(cores, 0)
    upper = (F.upper(found) == found) & (F.lower(found) != found)
    core_slots = F.regexp_replace(first["core"], "[^0-9A-Za-z]", "")
    chars = _chars(found)
    slotted = F.array_join(F.transform(chars, lambda c, k: F.when(c.rlike("[0-9A-Za-z]"), F.substr(core_slots, F.size(F.filter(F.slice(chars, 1, k), lambda x: x.rlike("[0-9A-Za-z]"))) + 1, F.lit(1))).otherwise(c)), "")
    honorific = F.regexp_extract(found, f"{_HONORIFIC}", 0)
    name = F.array_join(F.transform(cores, lambda x: x["core"]), " ")
    bare = F.substr(found, F.length(honorific) + 1)
    name = F.concat(honorific, F.when(F.upper(bare) == bare, F.upper(name)).otherwise(name))
    kind = first["kind"]
    return F.when(kind == "email", F.when(upper, F.upper(first["core"])).otherwise(first["core"])).when(kind == "ip", first["core"]).when(kind.rlike("^(given|family)"), name).otherwise(slotted)


def _bare_names(found: Column) -> Column:
    """``array<struct<size, form, parts>>``, longest form first: how the persons among mentions are called without an honorific."""
    named = F.filter(found, lambda x: x.rlike(f"^(?:{NAME})$"))

    def forms(x: Column) -> Column:
        parts, bare = parts_of(x), F.regexp_replace(x, _HONORIFIC, "")
        family = F.struct((-F.length(F.element_at(F.split(bare, " "), -1))).alias("size"), F.element_at(F.split(bare, " "), -1).alias("form"), F.slice(parts, -1, 1).alias("parts"))
        return F.array(F.struct((-F.length(bare)).alias("size"), bare.alias("form"), parts.alias("parts")), family)

    return F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(named, forms)))), lambda x: x["size"] <= -NAME_LETTERS)


def _pattern_with(forms: Column) -> Column:
    """The pattern of all kinds, and of those forms where there are any; they hold letters, hyphens, apostrophes and blanks alone."""
    bare = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), forms, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(forms == "", F.lit(PATTERN)).otherwise(bare)


def pseudonymise(docs: DataFrame, *, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced, and a last column ``pii``: ``array<struct<kind, surrogate>>`` in order of the text.

    Rows without personal data are unchanged, null texts included, and have an empty array. Mentions
    of one entity get one surrogate in all rows; entities that differ get surrogates that differ. A
    person's name without an honorific is replaced in documents that have it with one. Repeated rows
    get equal results. An empty table gives an empty result. Other columns stay as they are and may
    have any name but ``pii``, which a column of that name loses its place to. Whole texts are searched.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.when(text.rlike(_HINT) & text.rlike(PATTERN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    searched = docs.select(*row_key(id_col, text_col), text.alias("text"), found.alias("found")).filter(F.col("found").isNotNull())
    names = F.when(F.exists("found", lambda x: x.rlike(_HONORIFIC)), _bare_names(F.col("found"))).otherwise(F.array().cast("array<struct<size:int,form:string,parts:array<struct<kind:string,canon:string>>>>"))
    searched = searched.select("_id", "_hash", "text", "found", names.alias("names")).withColumn("forms", F.array_join(F.transform("names", lambda x: x["form"]), "|"))
    again = F.when(F.col("forms") == "", F.col("found")).otherwise(F.regexp_extract_all("text", _pattern_with(F.col("forms")), F.lit(0)))
    searched = searched.select("_id", "_hash", "names", "forms", again.alias("found")).dropDuplicates(["_id", "_hash"])
    bare = F.get(F.filter("names", lambda x: x["form"] == F.col("found")), 0)["parts"]
    mentions = searched.select("_id", "_hash", "names", "forms", F.posexplode("found").alias("place", "found"))
    mentions = materialize(mentions.select("_id", "_hash", "forms", "place", "found", F.coalesce(parts_of(F.col("found")), bare).alias("parts")), "mentions")
    parts = mentions.select("_id", "_hash", "forms", "place", "found", F.posexplode("parts").alias("part", "x")).select("_id", "_hash", "forms", "place", "found", "part", "x.*")
    core = surrogates(parts, key)
    named = parts.join(core, ["kind", "canon"]).groupBy("_id", "_hash", "place").agg(F.first("forms").alias("forms"), F.first("found").alias("found"), F.array_sort(F.collect_list(F.struct("part", "kind", "core"))).alias("cores"))
    replaced = named.select("_id", "_hash", "forms", F.struct("place", F.regexp_extract(F.get("cores", 0)["kind"], "^(family|given)?", 0).alias("person"), F.get("cores", 0)["kind"].alias("kind"), _in_format(F.col("found"), F.col("cores")).alias("surrogate")).alias("x"))
    replaced = replaced.groupBy("_id", "_hash").agg(F.first("forms").alias("__pii_forms"), F.array_sort(F.collect_list("x")).alias("xs"))
    replaced = replaced.select(F.col("_id").alias("__pii_id"), F.col("_hash").alias("__pii_hash"), "__pii_forms", F.transform("xs", lambda x: F.struct(F.when(x["person"] != "", "name").otherwise(x["kind"]).alias("kind"), x["surrogate"].alias("surrogate"))).alias("__pii"))
    own_id, own_hash = row_key(id_col, text_col)
    keyed = docs.withColumns({"__own_id": own_id, "__own_hash": own_hash})
    joined = keyed.join(replaced, (keyed["__own_id"] == replaced["__pii_id"]) & (keyed["__own_hash"] == replaced["__pii_hash"]), "left")
    gaps = F.split(keyed[text_col], _pattern_with(F.col("__pii_forms")), -1)
    rebuilt = F.array_join(F.zip_with(gaps, "__pii", lambda gap, x: F.concat(gap, F.coalesce(x["surrogate"], F.lit("")))), "")
    changed = F.when(F.col("__pii").isNotNull(), rebuilt).otherwise(keyed[text_col])
    columns = [changed.alias(text_col) if x == text_col else keyed[x] for x in docs.columns if x != "pii"]
    return joined.select(*columns, F.coalesce("__pii", F.array().cast("array<struct<kind:string,surrogate:string>>")).alias("pii"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")
