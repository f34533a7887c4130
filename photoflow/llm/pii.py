"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. Every pattern is written with possessive repeats and look-behinds, so the
search is linear also in very long runs of digits or letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_L = "A-Za-z0-9._%+-"
_D = "[A-Za-z0-9-]"

#: fixed values: characters of an account number by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: the country's own length; other codes take what follows, up to 34 characters
_IBAN = "|".join([*[f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()], f"(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"])

#: kind -> (pattern, cheap test that a text can hold a match, score, words whose nearness adds to it)
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (rf"(?:(?<![{_L}])|\G)[{_L}]++@{_D}++(?:\.{_D}++)++", "@", 0.7, "mail|contact|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", 0.7, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}[ A-Z0-9]", 0.6, "iban|bank|account|konto"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"\bssn\b|social security"),
    "tel": (r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "[0-9]{3}[ .-][0-9]{4}", 0.3, "phone|tel|call|mobile|fax"),
}
#: kinds that the checksum or shape alone confirms; the others need their context
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.25


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when a string of digits passes the Luhn test; null stays null."""

    def step(acc: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        return acc + F.when(k % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """True when an account number without spaces leaves 1 modulo 97, letters counting 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: Column, found: Column) -> Column:
    digits = _digits(found)
    n = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: F.when(p == "", True).when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))
    compact = F.regexp_replace(found, " ", "")
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False))
        .otherwise(True)
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """All confirmed spans, one row each, and one row with a null kind for every document.

    Returns _row (one value per input row, so repeated ids stay apart), id, kind, start and end (code
    points, end exclusive), found, score. A null text is empty and has no spans. Spans of one kind never
    overlap (leftmost first); spans of different kinds may. A span's context reaches back to the span of its
    kind before it, at most. A proposal that its checksum rejects is
    dropped and not searched again. Other columns of docs are ignored.
    """
    t = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    for kind, (pattern, test, _, _) in KINDS.items():
        may = F.col("t").contains(test) if test == "@" else F.col("t").rlike(test)
        t = t.withColumn(f"m_{kind}", F.when(may, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, (pattern, *_rest) in KINDS.items():
        # the pieces between matches give the positions: regexp_extract_all reports none
        t = t.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", pattern, -1)).otherwise(none))

    def proposals(kind: str) -> Column:
        p = F.col(f"p_{kind}")
        return F.transform(
            f"m_{kind}",
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(F.get(p, i)).alias("gap"), m.alias("found"),
                F.lower(F.right(F.get(p, i), F.lit(CONTEXT_CHARS))).alias("before"), F.lower(F.substring(F.get(p, i + 1), 1, CONTEXT_CHARS // 2)).alias("after"),
            ),
        )

    rows = t.select("_row", "id", F.explode_outer(F.concat(*[proposals(k) for k in KINDS])).alias("s")).select("_row", "id", "s.*")
    rows = rows.repartition("_row")
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + size).over(upto))
    near = F.lit(False)
    score = F.lit(0.0)
    for kind, (_, _, s, words) in KINDS.items():
        score = F.when(F.col("kind") == kind, s).otherwise(score)
        near = F.when(F.col("kind") == kind, F.concat_ws(" ", "before", "after").rlike(words)).otherwise(near)
    score = score + F.when(near, CONTEXT_BONUS).otherwise(0.0)
    keep = F.col("kind").isNull() | (_confirmed(F.col("kind"), F.col("found")) & (F.col("score") >= min_score))
    found = rows.withColumn("score", score).select(
        "_row", "id", F.when(keep, F.col("kind")).alias("kind"), (F.col("end") - size).alias("start"), "end", "found", "score",
    )
    return found


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts per base kind, the hash of the base spans, and all spans as text.

    Texts without spans have counts 0, the hash of the empty string and an empty span list.
    """
    spans = find_spans(docs, id_col, text_col)
    order = F.lit(len(KINDS))
    for n, kind in enumerate(KINDS):
        order = F.when(F.col("kind") == kind, n).otherwise(order)
    item = F.struct(order.alias("o"), F.col("start").alias("s"), F.concat_ws(":", "kind", "start", "end").alias("x"))
    grouped = spans.groupBy("_row").agg(
        F.first("id").alias(id_col),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all"),
        F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("score"))), F.lit(0.0)).alias("max_score"),
    )
    base = F.filter("all", lambda s: s["o"] < len(BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["x"]), ",")
    return grouped.select(
        id_col, *[f"n_{k}" for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), *[f"n_{k}" for k in KINDS if k not in BASE], "max_score"
    )
