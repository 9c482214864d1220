r"""Personal data by Spark expressions only: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds (email, ip, card, phone) are always reported. Two kinds are added: iban (confirmed modulo 97) and ssn, which
needs a context word to reach the threshold. A span's score is its kind's own plus a bonus if one of the kind's words
stands in the 48 characters before it.

The patterns are written so that matching is linear: a match can start only at the start of a run of its characters or
where the last one ended (\G), and repeats are possessive where that can't change a match.

Edge cases: null text counts as empty; an empty table gives an empty result; extra columns are kept by redact() and
ignored by detect(); repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, unused

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"
#: kind, pattern, own score, context words; in the order of the report.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|reply|write"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", 0.8, "card|visa|credit|debit|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, "iban|account|bank|transfer"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social|security"),
]
BASE = ("email", "ip", "card", "phone")
BONUS, NEAR, THRESHOLD = 0.3, 48, 0.6
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mod97(c: Column) -> Column:
    """Remainder of an IBAN, read with its first four characters last and letters as 10 to 35."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, ch: Column) -> Column:
        v = F.instr(F.lit(DIGITS), ch) - 1
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch)))


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(m) == 1)
    return F.lit(True)


def found(order: int, text: Column, m: Column) -> Column:
    """Confirmed spans of one kind. Places come from running lengths of matches and of what lies between them."""
    kind, pattern, own, words = KINDS[order]
    pairs = F.zip_with(m, F.split(text, pattern, -1), lambda x, g: F.struct(x.alias("m"), g.alias("g")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a.at + F.length(p.g)
        end = start + F.length(p.m)
        score = F.lit(own) + F.when(F.lower(F.right(p.g, F.lit(NEAR))).rlike(rf"\b(?:{words})"), BONUS).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))
        keep = confirmed(kind, p.m)
        if kind not in BASE:
            keep = keep & (score >= THRESHOLD)
        return F.struct(end.alias("at"), F.when(keep, F.concat(a.out, F.array(span))).otherwise(a.out).alias("out"))

    # past the last match there is only a rest, without a match
    all_ = F.aggregate(F.filter(pairs, lambda p: p.m.isNotNull()), state, step, lambda a: a.out)
    return F.when(F.size(m) > 0, all_).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: all spans by start, then kind; code points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    out, hits_of = docs, []
    for kind, pattern, *_ in KINDS:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        hits_of.append(unused(out, f"{name}_{kind}"))
        out = out.withColumn(hits_of[-1], F.when(needs[kind], hits).otherwise(none) if kind in needs else hits)
    spans = F.concat(*[found(i, text, F.col(f"`{c}`")) for i, c in enumerate(hits_of)])
    return out.withColumn(name, F.sort_array(spans)).drop(*hits_of)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the personal data in each text."""
    return with_spans(columns(docs, "doc_id", "text"), "spans").select("doc_id", "spans")


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind, as in [EMAIL]; spans that overlap become one of the first's kind."""
    name = unused(docs, "spans")
    spans = F.col(f"`{name}`")

    def merged(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        wider = last.withField("end", F.greatest(last.end, s.end))
        return F.when((F.size(a) == 0) | (s.start >= last.end), F.concat(a, F.array(s))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider)))

    marked = with_spans(docs, name).withColumn(name, F.when(F.size(spans) > 0, F.aggregate(spans, F.array().cast(SPAN), merged)).otherwise(spans))

    def part(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(spans, i - 1).end, F.lit(0))
        return F.concat(F.substring("text", at + 1, s.start - at), F.lit("["), F.upper(s.kind), F.lit("]"))

    last = F.element_at(spans, -1).end
    whole = F.concat(F.array_join(F.transform(spans, part), ""), F.substring("text", last + 1, F.length("text")))
    return marked.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(F.col("text"))).drop(name)
