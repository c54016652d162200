"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them alternate
(`regexp_extract_all` and `split` walk the text alike), so positions are running sums of
their lengths in code points, taken chunk by chunk so that no array is copied per match.
Patterns are possessive and anchored so that long runs of one class take linear time; a
cheap test skips texts that cannot match.

Kinds: email, ip, card (Luhn), phone, iban (mod 97), ssn and secret. A span's score starts
at the kind's prior, a passed checksum adds to it, and context words within 40 characters
on either side add or subtract. All spans of the four base kinds stay, with their score; of
the others, those that reach `min_score`: an iban goes where the words near it speak
against it, an ssn or a secret stays only where they speak for it.

Defined results: null or empty text has no spans (empty strings, the hash of the empty
string); null ids and repeated rows give a row each; other columns are ignored; an empty
table gives no rows; a text of any length is searched whole, in time and memory linear in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country of the table ends at its own length, so that a word or number after it is not taken in; others go as far as they can."""
    known = "|".join("|".join(c.split()) for c in IBAN_LENGTHS.values())
    own = [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{(n - 4) % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}}+)?+"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*own, other])})(?![A-Za-z0-9])"


#: Equivalent to the plain forms, but linear: possessive, and only from where a run of the class starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,256}+(?![A-Za-z0-9_/+-])",
}
#: Texts without a match of this have none of the kind.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?i)token|secret|key|passw|credential",
}
#: Scores in hundredths: the prior of a kind, what a passed checksum adds, what a context word adds or takes.
PRIOR = {"email": 70, "ip": 50, "card": 40, "phone": 50, "iban": 30, "ssn": 40, "secret": 40}
CHECKED = {"card": 30, "iban": 40}
CONTEXT = 20
CONTEXT_CHARS = 40
#: Matches whose positions are summed in one array.
CHUNK = 128
CONTEXT_PLUS = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|client",
    "card": r"(?i)card|credit|debit|visa|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|handy|num",
    "iban": r"(?i)iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": r"(?i)\bssn\b|social security|tax(?:payer)? id",
    "secret": r"(?i)token|secret|\b(?:api|access|private)[ _-]?key|passw|credential",
}
CONTEXT_MINUS = {
    "email": r"(?i)example|noreply",
    "ip": r"(?i)version|release|section|chapter",
    "card": r"(?i)isbn|order|serial|invoice|tracking",
    "phone": r"(?i)serial|part|model",
    "iban": r"(?i)serial|\bpart\b|model|invalid",
    "ssn": r"(?i)serial|\bpart\b|model|order",
    "secret": r"(?i)example|placeholder|checksum|sha-?1|sha-?256|md5",
}


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits ends in 0."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    added = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(added, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(compact: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        bare = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(12, 19) & _luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & _mod97(compact)
    if kind == "secret":
        return (n > 0) & match.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with the value taken once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column) -> Column:
    """Sums of an int array up to each element: within chunks, then over the chunks' totals."""

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("l"))
        add = lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["l"], F.array(s["t"] + x)).alias("l"))
        return F.aggregate(a, start, add, lambda s: s["l"])

    def chunked(a: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(CHUNK)), lambda c: sums(F.slice(a, c, CHUNK)))
        return _let(own, lambda o: _let(sums(F.transform(o, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))), lambda t: raised(o, t)))

    def raised(chunks: Column, totals: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda x, i: F.transform(x, lambda v: v + F.coalesce(F.get(totals, i - 1), F.lit(0)))))

    return _let(steps, chunked)


def kind_spans(text: Column, kind: str, confirmed: bool = False) -> Column:
    """array<struct<start, end, match, near>> of the matches of one kind that its validator confirms.

    Where only a context word can lift a span to the score that is asked for (`confirmed`), texts without one are not walked.
    """
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("p"), matches.alias("m"))
    last = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(CONTEXT_CHARS))
    first = lambda x: F.left(F.coalesce(x, F.lit("")), F.lit(CONTEXT_CHARS))

    def placed(s: Column) -> Column:
        p, m = s["p"], s["m"]
        # Neighbouring matches are part of the context; a line end keeps the two sides apart.
        before = lambda i: last(F.concat(last(F.get(p, i - 1)), last(F.get(m, i - 1)), last(F.get(p, i))))
        after = lambda i: first(F.concat(first(F.get(p, i + 1)), first(F.get(m, i + 1)), first(F.get(p, i + 2))))
        steps = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        ended = lambda e: F.transform(
            m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("match"), F.concat(before(i), F.lit("\n"), after(i)).alias("near"))
        )
        return _let(running_sums(steps), ended)

    found = F.filter(_let(both, placed), lambda x: _valid(kind, x["match"]))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")
    hinted = text.rlike(HINTS[kind])
    if confirmed:
        hinted = hinted & text.rlike(CONTEXT_PLUS[kind])
    return F.when(hinted, found).otherwise(empty)


def _scored(kind: str, spans: Column) -> Column:
    def score(near: Column) -> Column:
        words = F.when(near.rlike(CONTEXT_PLUS[kind]), CONTEXT).otherwise(0) - F.when(near.rlike(CONTEXT_MINUS[kind]), CONTEXT).otherwise(0)
        return (F.lit(PRIOR[kind] + CHECKED.get(kind, 0)) + words).cast("double") / 100

    order = KINDS.index(kind)
    return F.transform(
        spans,
        lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), score(x["near"]).alias("score"), x["match"].alias("match")),
    )


def find_pii(df: DataFrame, *, min_score: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and found: array<struct<start, order, kind, end, score, match>> in order of start, then kind."""
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    lifted = [k for k in KINDS if k not in BASE_KINDS and PRIOR[k] + CHECKED.get(k, 0) < 100 * min_score]
    rows = rows.select("_id", *(kind_spans(F.col("_text"), k, k in lifted).alias(k) for k in KINDS))
    parts = [_scored(k, F.col(k)) if k in BASE_KINDS else F.filter(_scored(k, F.col(k)), lambda x: x["score"] >= min_score) for k in KINDS]
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*parts)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
