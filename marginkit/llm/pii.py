r"""Personal data replaced by surrogates. DataFrame functions only.

Detected: e-mail addresses, IBANs, IPv4 addresses, secrets (``password=``, ``token: "..."``),
AWS access keys, card and account numbers (13 to 19 digits), phone numbers, US social
security numbers, and names after a title (Mr, Frau, Señora, г-жа ...).

Each distinct entity gets one surrogate, drawn from a keyed hash (SHA-512 of key, type,
entity and attempt), so the same entity has the same surrogate in all documents, and
nobody without the key can reverse it. Surrogates keep the type's form:

* digits become digits, letters letters of the same case and script (scripts without a row in
  ``LETTERS``: Latin ones), ASCII punctuation stays; phones keep
  their country code and layout, cards their first digit and a valid check digit if the
  original has one, IBANs country and a valid checksum, IPs their private range;
* e-mail domains end in the reserved ``.example``;
* names keep title, gender ending and script (Latin, Cyrillic, Greek); given names and
  surnames are entities of their own, so "Mrs. Anna Roe" and "Mrs. Roe" agree.

Entities of one type with equal surrogates, or whose surrogate is itself an entity found
in the data, are drawn anew (all but the smallest entity of each group) until none is
left, so different entities stay different. A form may have fewer surrogates than entities (192.168.x.y, a
secret of one letter): after ``FREE_DRAWS`` draws each further one makes the surrogate one character longer, and
addresses leave their range (10.x.x.x, then public ones, then IPv6), so the draws end.

A secret without a letter or digit (``password: ********``) is a mask and no entity.

Edge cases: null and empty texts stay as they are; overlapping matches go to the leftmost,
then the first type listed; repeated rows get equal results; an empty table gives an empty
result; other columns stay as they are, whatever their names; patterns take time in proportion to the
text, however long, and so do the surrogates.

Each text is searched once: the search cuts it into pieces, alternately text and mention, which are
written and read again. Only texts with a mention are joined with surrogates, keyed by the text's md5, so
copies and texts with many mentions cost one row per distinct mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Г-жа|г-жа|Госпожа|госпожа|Κυρία"
_MALE = "Mr|Herr|Señor|Sr|Monsieur|Г-н|г-н|Господин|господин|Κύριος"
_TITLE = f"{_FEMALE}|{_MALE}|Dr|Prof"
#: type -> Java pattern, in order of precedence
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[^\s\"'\p{L}\p{N}]*+[\p{L}\p{N}])[^\s\"']{6,}",
    "aws": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
             r"|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]?\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.?[ \t]+\p{{Lu}}[\p{{L}}'’-]+(?:[ \t]+\p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: a text without any of this holds no entity
MAYBE = rf"[0-9@]|AKIA|ASIA|(?i:passw|pwd|secret|token|api[_-]?key)|(?:{_TITLE})\.?[ \t]"
#: stands around mentions while a text is cut into pieces; a text's own are escaped
MARK = "\uffff"
#: draws of the entity's own form before surrogates get longer
FREE_DRAWS = 4
#: Java name of a script -> letters that stand for its letters
LETTERS = {
    "IsCyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω",
    "IsHebrew": "אבגדהוזחטילמנסעפצקרשת",
    "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsDevanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "IsHangul": "가나다라마바사아자차카타파하",
    "IsHan": "天地山水火木金土日月人口手足上下大小",
}
#: sixteen syllables for each script
SYLLABLES = {
    "latin": "ba de ki lo mu na pe ri so tu va we ze fo ga li",
    "cyrillic": "ба де ки ло му на пе ри со ту ва ве зе фо га ли",
    "greek": "βα δε κι λο μυ να πε ρι σο τυ φα χε ζε θο γα λι",
}
#: endings of given names by gender, and of surnames
ENDINGS = {"latin": ("na", "n", "l", "ner"), "cyrillic": ("на", "н", "ль", "нов"), "greek": ("να", "ν", "λ", "νης")}


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash_byte(i) -> Column:
    return F.conv(F.substring("h", (F.lit(i) - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), n % len(chars) + 1, F.lit(1))


def _same_form(text: Column, keep: int = 0) -> Column:
    """Digits to digits, letters to letters of the same case and script; ASCII punctuation and
    the first ``keep`` stay. In proportion to the length: characters are split, not sought."""
    latin = "abcdefghijklmnopqrstuvwxyz"

    def changed(c, i):
        r = _hash_byte(i + 1)
        letter = F
        for name, letters in LETTERS.items():
            letter = letter.when(c.rlike(rf"\p{{{name}}}"), _pick(letters, r))
        letter = letter.otherwise(_pick(latin, r))
        return (F.when(i < keep, c)
                .when(c.between("0", "9"), _pick("0123456789", r))
                .when(c.between("a", "z"), _pick(latin, r))
                .when(c.between("A", "Z"), _pick(latin.upper(), r)).when(F.ascii(c) < 128, c)
                .when(c.rlike(r"\p{N}"), _pick("0123456789", r))
                .when(c != F.lower(c), F.upper(letter)).otherwise(letter))
    return F.array_join(F.transform(F.split(text, ""), changed), "")


def _luhn(body: Column) -> Column:
    """Check digit for a string of digits."""
    def add(a, i):
        d = F.substring(body, i, F.lit(1)).cast("int")
        return a + F.when((F.length(body) - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    def add(a, i):
        c = F.substring(text, i, F.lit(1))
        return F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _syllables(script: str, kind: str) -> Column:
    parts = F.array(*[F.lit(s) for s in SYLLABLES[script].split()])
    f, m, n, last = ENDINGS[script]
    gender = F.substring("type", 7, 1)
    end = F.lit(last) if kind == "surname" else F.when(gender == "f", f).when(gender == "m", m).otherwise(n)
    stem = F.transform(F.sequence(F.lit(1), F.col("attempt") + 2), lambda i: F.element_at(parts, _hash_byte(i) % 16 + 1))
    return F.concat(F.array_join(stem, ""), end)


def _surrogate() -> Column:
    """The surrogate of (type, entity) from the hash ``h``. Numbers without layout. Built of
    columns: as SQL text, the parser's cache of it took 90 MB of the driver for good."""
    kind, entity, attempt, h = (F.col(c) for c in ("type", "entity", "attempt", "h"))
    octet = lambda k: (_hash_byte(k) % 254 + 1).cast("string")
    part = lambda k: F.element_at(F.split(entity, "[.]"), k)
    longer = F.greatest(attempt - FREE_DRAWS, F.lit(0))
    letters = F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), longer)
    digits = F.substring(F.translate(h, "abcdef", "012345"), F.lit(65), longer)
    card = F.concat(F.substring(entity, 1, 1), F.substring(_same_form(entity), F.lit(2), F.length(entity) - 2), digits)
    body = F.concat(_same_form(F.substr(entity, F.lit(5))), digits)
    country = F.substring(entity, 1, 2)
    hexes = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: _pick("0123456789abcdef", _hash_byte(i))), "")
    private, inside, wide = entity.like("192.168.%"), attempt < FREE_DRAWS, attempt >= 2 * FREE_DRAWS
    ipv6 = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substring(h, i * 4 + 1, F.lit(4)))
    first = (F.when(private & inside, "192").when((private | (part(1) == "10")) & ~wide, "10").when((part(1) == "127") & ~wide, "127")
             .otherwise((_hash_byte(1) % 89 + 11).cast("string")))
    good = _luhn(F.substring(entity, F.lit(1), F.length(entity) - 1)) == F.substring(entity, F.length(entity), F.lit(1))
    out = (F.when(kind == "email", F.concat(_same_form(F.regexp_extract(entity, "^([^@]*)@", 1)), letters, F.lit("@"), "_domain", F.lit(".example")))
           .when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), F.concat(hexes, F.substring(h, F.lit(65), longer)))
           .when(kind == "secret", F.concat(_same_form(entity), letters))
           .when(kind == "aws", _same_form(entity, 4))
           .when(kind == "iban", F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body))
           .when(kind == "phone", F.concat(F.regexp_extract(entity, "^([0-9]*)[|]", 1), _same_form(F.regexp_extract(entity, "[|]([0-9]*)$", 1)), digits))
           .when((kind == "ip") & (attempt >= 3 * FREE_DRAWS), F.concat(F.lit("2001:db8:"), F.array_join(ipv6, ":")))
           .when(kind == "ip", F.concat_ws(".", first, F.when(private & inside, "168").otherwise(octet(2)), octet(3), octet(4)))
           .when(kind == "ssn", F.concat(_same_form(entity), digits))
           .when(kind == "card", F.concat(card, F.when(good, _luhn(card)).otherwise(_pick("0123456789", _hash_byte(60))))))
    for name in ("given", "surname"):
        for script in SYLLABLES:
            out = out.when(kind.like(f"{name}%{script}"), _syllables(script, name))
    return out


def _parts(found: DataFrame) -> DataFrame:
    """(mention, pos, type, entity): the entities of each distinct mention, in a form that
    is the same for all spellings of the entity."""
    kind = "case " + " ".join(f"when mention rlike {_q('^(?:' + p + ')$')} then '{t}'" for t, p in PATTERNS.items()) + " end"
    typed = found.withColumn("type", F.expr(kind))
    digits = "regexp_replace(mention, '[^0-9]', '')"
    country = f"case when mention like '+%' then substring({digits}, 1, if(substring({digits}, 1, 1) in ('1', '7'), 1, 2)) else '' end"
    plain = typed.where("type <> 'person'").selectExpr("mention", "0 as pos", "type", f"""case
        when type = 'email' then lower(mention)
        when type = 'secret' then regexp_extract(mention, {_q(_SECRET)}, 2)
        when type = 'iban' then replace(mention, ' ', '')
        when type = 'phone' then concat({country}, '|', substring({digits}, length({country}) + 1))
        when type in ('ssn', 'card') then {digits} else mention end as entity""")
    gender = (f"case when mention rlike {_q('^(?:' + _FEMALE + ')(?![a-zа-я])')} then 'f' "
              f"when mention rlike {_q('^(?:' + _MALE + ')(?![a-zа-я])')} then 'm' else 'n' end")
    names = typed.where("type = 'person'").withColumn("_gender", F.expr(gender)).withColumn("_names", F.expr(f"split(regexp_extract(mention, {_q(_NAME)}, 2), '[ \\\\t]+')"))
    script = r"case when entity rlike '\\p{IsCyrillic}' then 'cyrillic' when entity rlike '\\p{IsGreek}' then 'greek' else 'latin' end"
    tokens = names.select("mention", "_gender", F.size("_names").alias("_n"), F.posexplode("_names").alias("pos", "_token"))
    tokens = tokens.withColumn("entity", F.lower("_token")).selectExpr(
        "mention", "pos", f"concat(if(pos = _n - 1, 'surname', concat('given:', _gender)), ':', {script}) as type", "entity")
    return plain.unionByName(tokens)


_SECRET = r"(?s)^((?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(.*)$"
_NAME = r"^([^ \t]+[ \t]+)(.*)$"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to distinct (type, entity): different entities of a type differ."""
    domain = F.expr("sha2(concat(%s, '|domain|', regexp_extract(entity, '@(.*)$', 1)), 512)" % _q(key))
    site = F.expr("regexp_replace(regexp_extract(entity, '@(.*)$', 1), '[.][^.]*$', '')")
    state = entities.withColumn("attempt", F.lit(0))
    while True:
        named = state.withColumn("h", domain).withColumn("_site", site).withColumn("_domain", _same_form(F.col("_site")))
        named = named.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "type", "entity", F.col("attempt").cast("string")), 512))
        named = materialise(named.select("type", "entity", "attempt", _surrogate().alias("surrogate")), "surrogates")
        taken = F.when(F.col("type") == "phone", F.replace("entity", F.lit("|"))).otherwise(F.col("entity"))
        known = named.select("type", taken.alias("surrogate")).distinct().withColumn("_known", F.lit(True))
        first = (named.groupBy("type", "surrogate").agg(F.min("entity").alias("_first"), F.count(F.lit(1)).alias("_n"))
                 .join(known, ["type", "surrogate"], "left").where("_n > 1 or _known"))
        first = materialise(first.selectExpr("type", "surrogate", "if(_known, null, _first) as _first"), "collisions")
        if first.isEmpty():
            return named.drop("attempt")
        again = named.join(first.withColumn("_hit", F.lit(True)), ["type", "surrogate"], "left")
        state = again.selectExpr("type", "entity", "attempt + if(_hit and not (entity <=> _first), 1, 0) as attempt")


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(mention, type, replacement) of each distinct mention."""
    parts = materialise(_parts(found), "mentions")
    named = surrogates(parts.select("type", "entity").distinct(), key)
    joined = parts.join(named, ["type", "entity"])
    whole = joined.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "surrogate"))).alias("p"))
    c = "substring(mention, i, 1)"
    plain = "length(regexp_replace(mention, '[^A-Za-z0-9]', ''))"
    layout = (f"array_join(transform(sequence(1, length(mention)), i -> case when {c} rlike '[A-Za-z0-9]' then "
              f"substring(p[0].surrogate, length(regexp_replace(substring(mention, 1, i), '[^A-Za-z0-9]', '')), 1) else {c} end), '')")
    title = f"regexp_extract(mention, {_q(_NAME)}, 1)"
    token = f"split(regexp_extract(mention, {_q(_NAME)}, 2), '[ \\\\t]+')[x.pos]"
    name = (f"concat({title}, array_join(transform(p, x -> case when length({token}) > 1 and upper({token}) = {token} "
            f"then upper(x.surrogate) else concat(upper(substring(x.surrogate, 1, 1)), substring(x.surrogate, 2)) end), ' '))")
    kind = "split(p[0].type, ':')[0]"
    return whole.selectExpr("mention", f"if({kind} in ('given', 'surname'), 'person', {kind}) as type", f"""case
        when {kind} in ('given', 'surname') then {name}
        when {kind} = 'secret' then concat(regexp_extract(mention, {_q(_SECRET)}, 1), p[0].surrogate)
        when {kind} in ('phone', 'card', 'ssn', 'iban') then concat({layout}, substring(p[0].surrogate, {plain} + 1))
        when {kind} = 'email' and upper(mention) = mention then upper(p[0].surrogate)
        else p[0].surrogate end as replacement""")


def pieces(body: F.Column) -> F.Column:
    """The text cut at its mentions: text, mention, text, ..., text. Joined they are the text."""
    escaped = F.replace(body, F.lit(MARK), F.lit(MARK + "_"))
    marked = F.regexp_replace(escaped, f"({PATTERN})", MARK + "<$1" + MARK + "<")
    cut = F.split(F.when(body.rlike(MAYBE), marked).otherwise(escaped), MARK + "<", -1)
    return F.transform(cut, lambda c: F.replace(c, F.lit(MARK + "_"), F.lit(MARK)))


def replace_pii(docs: DataFrame, key: str = "surrogates", text: str = "text", count: str | None = None) -> DataFrame:
    """The documents with every mention replaced; columns stay as they are, plus the
    number of mentions as ``count`` if that is given."""
    body = F.col(f"`{text}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[c.alias(f"c{i}") for i, c in enumerate(others)]).alias("_row"),
                       F.md5(body).alias("_digest"), pieces(body).alias("_pieces"))
    rows = materialise(rows, "pii-pieces")
    hits = rows.where(F.size("_pieces") > 1)
    mention = F.explode(F.array_distinct(F.filter("_pieces", lambda p, i: i % 2 == 1)))
    pairs = materialise(hits.select("_digest", mention.alias("mention")).distinct(), "pii-found")
    table = materialise(replacements(pairs.select("mention").distinct(), key), "pii-replacements")
    maps = pairs.join(table, "mention").groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("_map"))
    joined = hits.join(materialise(maps, "pii-maps"), "_digest")
    new = F.transform("_pieces", lambda p, i: F.when(i % 2 == 1, F.element_at("_map", p)).otherwise(p))
    changed = joined.select("_row", F.array_join(new, "").alias("_new"), F.floor(F.size("_pieces") / 2).cast("long").alias("_n"))
    same = rows.where((F.size("_pieces") <= 1) | F.col("_pieces").isNull()).select("_row", F.array_join("_pieces", "").alias("_new"), F.lit(0).cast("long").alias("_n"))
    place = {c: i for i, c in enumerate(c for c in docs.columns if c != text)}
    columns = [F.col("_new").alias(c) if c == text else F.col(f"_row.c{place[c]}").alias(c) for c in docs.columns]
    return changed.unionByName(same).select(*columns, *([F.col("_n").alias(count)] if count else []))
