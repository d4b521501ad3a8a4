"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score. DataFrame functions only.

For each kind a pattern is matched leftmost and without overlap. Spark's matchers return matches without positions, so the
text is also split by the same pattern: pieces and matches alternate, and running sums of their lengths are the positions
(in code points, end exclusive). Sums run in blocks of BLOCK matches, and over the blocks, so that a text with very many matches stays
linear. A match that fails its check is dropped and not tried again at a later start.

Kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits). This method adds two: iban, two
letters, two check digits, 11 to 30 more letters or digits, confirmed by mod 97 (ISO 13616); and secret, a run of 24 to 128
characters of an encoded key in which at least four digits and four letters stand.

Each span has a score: a prior of its kind, raised by a passed check and by a context word of its kind, whole and in any case, within the
last `CONTEXT` characters of the piece before it or the first half as many of the piece after it. Base spans are kept whatever their score. Added kinds need `ADDED_SCORE`: an
iban has it by its checksum, a run of characters is a secret only where a word such as "token" or "key" stands by it.

The patterns never scan a run of characters twice: quantifiers are possessive, and a run is entered at its start only (or
where the last match ended), so that texts that are one long word or number stay linear.

Defined results: a null text counts as empty: no spans. A null id is kept. Repeated rows are each judged. Other columns are
ignored. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm.common import table

# Fixed values of the contract: the patterns of the base kinds, in forms that match the same spans.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,128}+={0,2}+(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
BASE, ADDED = KINDS[:4], KINDS[4:]
# A text without these cannot match, which a plain search finds out sooner.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Words that speak for a kind, and priors before and after a checksum.
WORDS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "server", "host", "address", "network"),
    "card": ("card", "visa", "credit", "payment", "pay", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.5, "secret": 0.3, "iban": 0.3}
CHECKED = {"email": 0.0, "ip": 0.0, "card": 0.4, "phone": 0.0, "secret": 0.2, "iban": 0.3}
CONTEXT, CONTEXT_RAISE, ADDED_SCORE = 40, 0.2, 0.6
#: Matches whose positions are summed up together.
BLOCK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder of an account code: first four characters last, letters as 10 to 35, read as one number."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    places = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(places, F.lit(0), lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97)


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # a part of more than three digits after leading zeros is above 255
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("999").cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":
        return (F.length(digits) >= 4) & (F.length(F.regexp_replace(match, "[^A-Za-z]", "")) >= 4)
    if kind == "iban":
        code = F.regexp_replace(match, " ", "")
        return F.length(code).between(15, 34) & (mod97(code) == 1)
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """A word counts if no letter stands next to it; one cut off at the edge of the context is not whole."""
    near = F.lower(F.concat(F.right(F.concat(F.lit(" "), before), F.lit(CONTEXT + 1)), F.lit("\n"), F.left(F.concat(after, F.lit(" ")), F.lit(CONTEXT // 2 + 1))))
    words = F.rlike(near, F.lit(rf"(?<=[^\p{{L}}])(?:{'|'.join(WORDS[kind])})(?=[^\p{{L}}])"))
    return F.lit(PRIOR[kind] + CHECKED[kind]) + F.when(words, CONTEXT_RAISE).otherwise(0.0)


def propose(kind: str, text: Column) -> Column:
    """(match, start, end) of every match of the kind's pattern."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    return F.struct(hits.alias("hits"), gaps.alias("gaps"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def located(found: Column) -> Column:
    """(match, start, end, before, after) of each match: it starts where the pieces and matches before it end."""
    n = F.size(found["hits"])
    pairs = F.arrays_zip(found["hits"].alias("hit"), F.slice(found["gaps"], F.lit(1), n).alias("before"), F.slice(found["gaps"], F.lit(2), n).alias("after"))
    none = F.array().cast("array<struct<match:string,start:int,end:int,before:string,after:string>>")

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, F.lit(BLOCK)))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["before"]) + F.length(x["hit"]))

    def begins(b: Column) -> Column:
        seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(F.transform(b, length), seed, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["hit"])
        span = F.struct(x["hit"].alias("match"), start.alias("start"), end.alias("end"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    def spans(b: Column) -> Column:
        return F.flatten(F.zip_with(b, begins(b), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]))

    return let(pairs, lambda p: let(blocks(p), spans))


def judged(kind: str, found: Column) -> Column:
    """The confirmed spans of a kind with their scores."""
    place = KINDS.index(kind)

    def scored(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(kind, s["before"], s["after"]).alias("score"), s["match"].alias("match"))

    return F.transform(F.filter(located(found), lambda s: confirmed(kind, s["match"])), scored)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: an array of (start, place of the kind, end, kind, score, match), by start and kind."""
    out = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    for kind in KINDS:
        may = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.rlike("text", F.lit(PATTERNS[kind]))
        out = out.withColumn(f"raw_{kind}", F.when(may, propose(kind, F.col("text"))))
    for kind in KINDS:
        out = out.withColumn(f"at_{kind}", F.when(F.size(F.col(f"raw_{kind}.hits")) > 0, judged(kind, F.col(f"raw_{kind}"))))
    empty = F.array().cast(out.schema["at_email"].dataType)
    # added kinds must reach the score (of tenths: half a tenth for rounding); they may overlap base spans, which all stay
    added = [F.filter(F.coalesce(f"at_{k}", empty), lambda s: s["score"] > ADDED_SCORE - 0.05) for k in ADDED]
    every = F.concat(*[F.coalesce(f"at_{k}", empty) for k in BASE], *added)
    return out.select("id", F.array_sort(every).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def line(kinds: list[str]) -> Column:
        kept = F.filter("spans", lambda s: s["kind"].isin(kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(line(BASE), 256).alias("base_sha256"), line(KINDS).alias("spans"),
        *[count(k) for k in ADDED], F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"),
    )
