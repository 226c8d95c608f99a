"""Personal data: patterns propose, checksums confirm, nearby words adjust a score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planeframe.llm import spans as S
from planeframe.llm.common import narrow

KINDS = ["email", "ip", "card", "phone", "iban"]

# Fixed by the contract, written with possessive repeats and starts at the edge of a run: the matches are
# the same (a repeat is never followed by a character that it could take), but a long run costs linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country; fixed values.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: The method's own proposal: two letters, two check digits and as many more as the country's have, perhaps in
#: blocks; for other letters 11 to 30 more, but not into what begins like an IBAN of one of the countries.
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items())
    + rf"|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_COUNTRIES})[0-9]{{2}}))?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))"
)

#: Words near a span that raise its score, by kind: English, German, French and Spanish; fixed values.
CONTEXT = {
    "email": "mail email contact write address kontakt schreiben adresse courriel courrier contacter écrire correo contacto escribir dirección",
    "ip": "ip host server address network rechner adresse netzwerk serveur hôte réseau servidor dirección red",
    "card": "card visa mastercard credit payment karte kreditkarte zahlung carte crédit paiement tarjeta crédito pago",
    "phone": "phone tel telephone call mobile fax telefon anruf handy mobil téléphone appeler portable teléfono llamar móvil",
    "iban": "iban bank account transfer konto überweisung banque compte virement banco cuenta transferencia",
}
#: Code points before and after a span in which those words are looked for; the scores without and with one.
NEAR, BASE, RAISED = 40, 0.6, 0.9
#: Code points of the pieces from which surroundings are taken.
PIECE = 4096


def _octet(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 4) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


def _ip_ok(x: Column) -> Column:
    return F.forall(F.split(x["text"], r"\."), _octet)


def _card_ok(x: Column) -> Column:
    digits = F.translate(x["text"], " -", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def _phone_ok(x: Column) -> Column:
    return F.length(F.regexp_replace(x["text"], "[^0-9]", "")).between(9, 15)


def _iban_ok(x: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    bare = F.translate(x["text"], " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(bare).between(15, 34) & (rest == 1)


def _score(pieces: Column, span: Column, size: Column) -> Column:
    """RAISED if a word of the span's kind stands, whole, within NEAR code points before or after it. pieces are the
    text in stretches of PIECE code points, so that a span costs the same wherever it stands."""
    at = lambda place: F.floor(place / PIECE).cast("int")
    between = lambda lo, hi: F.substring(
        F.concat(F.coalesce(F.get(pieces, at(lo)), F.lit("")), F.coalesce(F.get(pieces, at(lo) + 1), F.lit(""))), (lo % PIECE + 1).cast("int"), (hi - lo).cast("int")
    )
    # what is cut at the far edge has no other character beside it there, and so is no whole word
    lo, hi = F.greatest(span["start"] - NEAR, F.lit(0)), F.least(span["end"] + NEAR, size)
    before = F.concat(F.when(lo == 0, F.lit(" ")).otherwise(F.lit("")), between(lo, span["start"]), F.lit(" "))
    after = F.concat(F.lit(" "), between(span["end"], hi), F.when(hi == size, F.lit(" ")).otherwise(F.lit("")))
    near = F.lower(F.concat(before, F.lit("\n"), after))
    hit = F.lit(False)
    for i, kind in enumerate(KINDS):
        hit = hit | ((span["kind"] == i) & near.rlike(rf"\P{{L}}(?:{CONTEXT[kind].replace(' ', '|')})(?=\P{{L}})"))
    return F.when(hit, F.lit(RAISED)).otherwise(F.lit(BASE))


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in `text` of docs(doc_id, text), one row for each row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the four base kinds' spans), spans (all
    spans, IBANs too), n_iban, scores (comma-joined, in the order of spans: higher where a word of the kind's context
    stands near). Spans are kind:start:end in
    code points, end exclusive, by start, then kind as in KINDS. A null text counts as empty; a null doc_id
    stays null; repeated rows give repeated rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    df = df.select(
        "doc_id",
        "text",
        S.matches(text, EMAIL, where=text.contains("@")).alias("m0"),
        S.matches(text, IP, where=digit).alias("m1"),
        S.matches(text, CARD, where=digit).alias("m2"),
        S.matches(text, PHONE, where=text.contains("+")).alias("m3"),
        S.matches(text, IBAN, where=digit).alias("m4"),
    )
    df = df.select(
        "doc_id",
        "text",
        S.placed(F.col("m0"), 0, lambda x: F.lit(True)).alias("s0"),
        S.placed(F.col("m1"), 1, _ip_ok).alias("s1"),
        S.placed(F.col("m2"), 2, _card_ok).alias("s2"),
        S.placed(F.col("m3"), 3, _phone_ok).alias("s3"),
        S.placed(F.col("m4"), 4, _iban_ok).alias("s4"),
    )
    df = df.select("*", S.ordered("s0", "s1", "s2", "s3").alias("base"), S.ordered("s0", "s1", "s2", "s3", "s4").alias("every"))
    pieces = F.when(F.size("every") > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)"))
    df = df.select("*", pieces.alias("pieces"), F.length(text).cast("bigint").alias("size"))
    return df.select(
        "doc_id",
        S.number(F.col("s0")).alias("n_email"),
        S.number(F.col("s1")).alias("n_ip"),
        S.number(F.col("s2")).alias("n_card"),
        S.number(F.col("s3")).alias("n_phone"),
        F.sha2(S.listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        S.listed(F.col("every"), KINDS).alias("spans"),
        S.number(F.col("s4")).alias("n_iban"),
        F.array_join(F.transform("every", lambda s: _score(F.col("pieces"), s, F.col("size")).cast("string")), ",").alias("scores"),
    )
