"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust
a score. DataFrame functions only; every row is worked out on its own, without a shuffle.

Spans are in code points, end exclusive, leftmost and non-overlapping per kind. The patterns
are written so that the Java matcher neither recurses nor rescans: very long runs of digits,
labels or separators take linear time and constant stack.

Null and empty texts have no spans. Repeated rows give repeated results; columns other than the
id and the text are not read, so clashing names don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _number(char: Column) -> Column:
    """0-9 for digits, 10-35 for A-Z."""
    code = F.ascii(char)
    return F.when(code < 58, code - 48).otherwise(code - 55)


def luhn_valid(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    def weight(c: Column, i: Column) -> Column:
        n = F.ascii(c) - 48
        doubled = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_valid(account: Column) -> Column:
    """ISO 7064 mod 97 over an account number without blanks: country and check digits go last."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        F.transform(chars, _number), F.lit(0),
        lambda a, n: (a * F.when(n < 10, 10).otherwise(100) + n) % 97,
    )
    return rest == 1


def _ip_valid(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``mark`` rewrites the text, code point for code point, so that
    ``pattern`` can be a plain run of characters; ``gate`` is a cheap test that a text may hold
    the kind at all. A span counts if ``valid`` holds and prior + checksum + context >= floor."""

    name: str
    gate: str
    pattern: str
    mark: tuple[str, str] | None
    valid: object
    prior: float
    checksum: float
    words: str
    floor: float


_LABEL = "[A-Za-z0-9-]"
_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    # A dot that doesn't stand between two label characters becomes "_": it may be in the local
    # part, where both count alike, but never in a domain, which is then one run of characters.
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.[A-Za-z0-9.-]++",
         (rf"(?<!{_LABEL})\.|\.(?!{_LABEL})", "_"), lambda m: F.lit(True), 0.9, 0.0, "mail|contact", 0.5),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         None, _ip_valid, 0.6, 0.0, r"\bip\b|address|host|server", 0.5),
    # A blank or hyphen without a digit on either side becomes "x": cards are then runs, too.
    Kind("card", "[0-9][0-9 -]{11}", "[0-9][0-9 -]{11,}+", ("[ -](?![0-9])|(?<![0-9])[ -]", "x"),
         lambda m: let(_digits(m), lambda d: F.length(d).between(13, 19) & luhn_valid(d)),
         0.3, 0.5, "card|visa|credit|karte|carte|tarjeta", 0.5),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", None,
         lambda m: F.length(_digits(m)).between(9, 15), 0.7, 0.0, "phone|call|tel|mobile", 0.5),
    # Added by the method: account numbers by mod 97, and identity numbers by their context only.
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         None, lambda m: mod97_valid(F.translate(m, " ", "")), 0.1, 0.6, "iban|bank|account|konto|compte|cuenta", 0.5),
    Kind("national_id", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None,
         lambda m: ~m.rlike("^(?:000|666|9)|^...-00|0000$"), 0.3, 0.0, r"ssn|social|security|\bid\b|identity", 0.5),
)
CONTEXT_BONUS, BEFORE, AFTER = 0.3, 40, 20


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind. What stands between the matches gives their places: the k-th
    starts after k + 1 gaps and k matches."""
    def found(marked: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def place(m: Column, k: Column) -> Column:
                near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, k), F.lit(BEFORE)), F.left(F.get(gaps, k + 1), F.lit(AFTER))))
                score = F.lit(kind.prior + kind.checksum) + F.when(near.rlike(kind.words), CONTEXT_BONUS).otherwise(0.0)
                return F.struct(
                    F.length(F.get(gaps, k)).alias("gap"), F.length(m).alias("size"),
                    F.least(score, F.lit(1.0)).alias("score"), kind.valid(m).alias("valid"),
                )

            def walk(acc: Column, x: Column) -> Column:
                start = acc["at"] + x["gap"]
                span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), x["score"].alias("score"))
                kept = F.when(x["valid"] & (x["score"] >= kind.floor), F.array(span)).otherwise(F.array().cast(SPAN))
                return F.struct((start + x["size"]).alias("at"), F.concat(acc["spans"], kept).alias("spans"))

            start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
            placed = F.transform(F.regexp_extract_all(marked, F.lit(kind.pattern), F.lit(0)), place)
            return F.aggregate(placed, start, walk, lambda acc: acc["spans"])

        return let(F.split(marked, kind.pattern, -1), with_gaps)

    marked = F.regexp_replace(text, *kind.mark) if kind.mark else text
    gate = F.contains(text, F.lit("@")) if kind.gate == "@" else text.rlike(kind.gate)
    return F.when(gate, let(marked, found)).otherwise(F.array().cast(SPAN))


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """Adds ``into``: the spans of every text, by kind in the order of ``KINDS``, then by start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = [_spans(whole, kind).alias(f"_{kind.name}") for kind in KINDS]
    rows = docs.select("*", *parts)
    return rows.withColumn(into, F.concat(*[F.col(f"_{k.name}") for k in KINDS])).drop(*[f"_{k.name}" for k in KINDS])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become
    one, named after the first to start. Null stays null."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def walk(acc: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.when(
            s["start"] >= acc["at"],
            F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(
        ordered, start, walk,
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""),
    )
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, personal data replaced in ``text``."""
    found = find_personal_data(docs, text, "_pii_found")
    return found.withColumn(text, redacted(F.col(text), F.col("_pii_found"))).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and listing of the spans of every document."""
    found = find_personal_data(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: Kind) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts[:4], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), *counts[4:],
        F.round(F.array_min(F.transform("pii_spans", lambda s: s["score"])), 6).alias("least_score"),
    )
