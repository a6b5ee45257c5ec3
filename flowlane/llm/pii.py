"""Personal data in text: regular expressions propose spans, checksums and value
ranges confirm them, and words nearby adjust a score.

Column expressions only. A pattern's matches and the texts between them come
from one extraction and one split with the same pattern, so a match's place is
the summed length of what stands before it; the sums are built in blocks, so a
text with very many matches costs far less than a square. Quantifiers are
possessive and starts are tied to the begin of a run where the pattern allows,
so long runs that do not match cost one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import free_name

# What each kind looks like (same language as the plain patterns
# `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` and so on).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
#: A cheap test that every text with a match passes.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
}
#: Score of a confirmed span without any word nearby, and words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
NEARBY = {
    "email": r"(?i)(mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?i)(\bip\b|address|host|server|adresse)",
    "card": r"(?i)(card|visa|credit|karte|tarjeta|carte)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|anruf|llam|appel)",
    "iban": r"(?i)(iban|bank|account|konto|cuenta|compte)",
}
REACH = 40  # characters before and after a span that count as nearby
BONUS = 0.2


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.aggregate(
        F.array(F.coalesce(c.try_cast("int"), F.lit(0)) * (i % 2 + 1)), F.lit(0),
        lambda _, d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN of 15 to 34 signs, without blanks, passes the mod-97 check."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    digits = F.aggregate(F.split(moved, ""), F.lit(""), lambda a, c: F.concat(
        a, F.when(c < "A", c).otherwise((F.ascii(c) - 55).cast("string"))))
    # at most 68 digits: 34 at a time, each remainder put before the next ones
    first = F.substring(digits, 1, 34).cast("decimal(38,0)") % 97
    return F.concat(first.cast("string"), F.substring(digits, 35, 34)).cast("decimal(38,0)") % 97 == 1


def confirmed(kind: str, value: Column) -> Column:
    """The checksum or range test of one proposed span."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def _running(lengths: Column, block: int = 256) -> Column:
    """For an array of longs, the sum of the elements before each one."""
    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("p"))
        return F.aggregate(a, start, lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.array_append(acc["p"], acc["s"]).alias("p")))

    def offsets(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")),
                            lambda b: sums(F.slice(a, b * block + 1, F.lit(block))))
        return F.transform(F.array(parts), lambda ps: F.flatten(F.zip_with(
            ps, sums(F.transform(ps, lambda p: p["s"]))["p"], lambda p, o: F.transform(p["p"], lambda x: x + o))))[0]

    # a lambda's argument is computed once, however often it is used
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.array(lengths), offsets)[0])


def proposals(text: Column, kind: str) -> Column:
    """array<struct<value, before, near>>: matches of a kind, what stands between them
    (``before`` reaches to the previous match), and whether one of the kind's words is
    within ``REACH`` characters before or after. That text may hold one neighbouring match
    on either side; of a chain of matches closer together, the next one only."""
    pattern = PATTERNS[kind]
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                            F.split(text, pattern, -1).alias("p")))

    def at(a: Column, i: Column, side) -> Column:
        """The end of an element that is nearest to the match, empty beyond the ends."""
        return F.coalesce(side(F.get(a, i), F.lit(REACH)), F.lit(""))

    def near(x: Column, i: Column) -> Column:
        before = F.concat(F.when(i > 0, F.concat(at(x["p"], i - 1, F.right), at(x["m"], i - 1, F.right))).otherwise(""),
                          at(x["p"], i, F.right))
        after = F.concat(at(x["p"], i + 1, F.left), at(x["m"], i + 1, F.left), at(x["p"], i + 2, F.left))
        return (F.right(before, F.lit(REACH)).rlike(NEARBY[kind])) | (F.left(after, F.lit(REACH)).rlike(NEARBY[kind]))

    lists = F.transform(both, lambda x: F.transform(x["m"], lambda m, i: F.struct(
        m.alias("value"), F.get(x["p"], i).alias("before"), near(x, i).alias("near"))))[0]
    none = F.array().cast("array<struct<value:string,before:string,near:boolean>>")
    return F.when(HINTS[kind](text), lists).otherwise(none)


def with_spans(docs: DataFrame, name: str = "spans", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``name``: array<struct<kind, start, stop, score>> of confirmed
    spans (code points, ``stop`` exclusive) by start, then kind in the order of
    ``KINDS``. A null text counts as empty and has none."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = []
    raws = {k: free_name(docs, f"found_{k}") for k in KINDS}
    out = docs.withColumns({raws[k]: proposals(text, k) for k in KINDS})
    for i, kind in enumerate(KINDS):
        raw = F.col(raws[kind])
        lengths = F.transform(raw, lambda x: (F.length(x["before"]) + F.length(x["value"])).cast("long"))
        placed = F.zip_with(raw, _running(lengths), lambda x, at: F.struct(
            (at + F.length(x["before"])).alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"),
            (at + F.length(x["before"]) + F.length(x["value"])).alias("stop"),
            F.when(x["near"], min(1.0, SCORES[kind] + BONUS)).otherwise(SCORES[kind]).alias("score"), x["value"].alias("value")))
        ok = F.filter(placed, lambda x: confirmed(kind, x["value"]))
        found.append(F.when(F.size(raw) == 0, F.array().cast(SPAN)).otherwise(F.transform(ok, lambda x: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["stop"].alias("stop"),
            x["score"].alias("score")))))
    return (out.withColumn(name, F.array_sort(F.concat(*found))).drop(*raws.values()))


SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,score:double>>"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts of the four base kinds, the digest of the
    base spans, and all spans as text, with their scores in the same order.

    A null or empty text has no spans (digest of the empty string). Null ids stay
    null, repeated rows give repeated rows, other columns are not read, an empty
    table gives no rows.
    """
    held = with_spans(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "found")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")  # noqa: B023
              for k in BASE]
    return held.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.col("found")).alias("spans"),
                       F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 1)), ",").alias("scores"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each confirmed span replaced by its kind in brackets, kind by
    kind in the order of ``ORDER``, so that what one kind takes is no part of the
    next; digits that ran into a neighbour's are looked at again in the end. ``chars_col``, if
    there, follows the new text. Rows without spans, null texts and null ids included, stay as
    they are, repeated rows too; other columns stay, whatever they are called; an empty
    table gives no rows."""
    t = f"`{text_col}`"
    new = free_name(docs, "redacted")
    out = docs.withColumn(new, F.col(t).cast("string"))
    for kind in ORDER:
        pattern, text = PATTERNS[kind], F.col(new)
        both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                                F.split(text, pattern, -1).alias("p")))
        swapped = F.transform(both, lambda x: F.concat(
            F.array_join(F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: F.concat(
                p, F.when(confirmed(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m))), ""),
            F.element_at(x["p"], -1)))[0]
        out = out.withColumn(new, F.when(HINTS[kind](text), swapped).otherwise(text))
    changed = ~F.col(new).eqNullSafe(F.col(t).cast("string"))
    fresh = {text_col: F.col(new)}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        fresh[chars_col] = F.when(changed, F.length(new)).otherwise(F.col(f"`{chars_col}`")).cast(kind)
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


ORDER = ["email", "iban", "phone", "ip", "card", "phone", "card"]
