"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm them, context adjusts scores.

The patterns are written so that Java's matcher needs no deep stack and no quadratic time: runs are possessive, and a
match may start inside a run only where the last match ended (`\\G`), where it would be found anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.places import between, chunks, match_places, once, running_maxima

from .common import LOWER, UPPER, whole_text

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """hint: a cheap pattern or string without which no match is possible; score: what the pattern alone is worth;
    confirmed: what a passed checksum or shape adds; words: context that adds CONTEXT_SCORE. The pattern of an IBAN
    matches its first four characters and looks ahead at what may follow; see `_iban_spans`."""

    name: str
    pattern: str
    hint: str
    score: float
    confirmed: float
    words: str


#: In the order of results. The first four are the base kinds: a confirmed one always reaches the threshold.
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", 0.9, 0.0, "mail|contact"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", 0.3, 0.5, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]{2}|[0-9][\x20-][0-9]", 0.1, 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.3, 0.4, "phone|call|tel|mobile"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,31}+))", r"[A-Z]{2}[0-9]{2}", 0.1, 0.7, "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.1, 0.2, "ssn|social security|tax"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: Lengths of the countries' IBANs (fixed values of the public registry).
IBAN_LENGTHS = {country: int(size) for size, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for country in countries.split(",")}
CONTEXT_CHARS, CONTEXT_SCORE, THRESHOLD = 40, 0.3, 0.6


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Does a string of A-Z and 0-9 pass the IBAN check (ISO 7064 mod 97-10)?"""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod_97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("^...-00|-0000$")
    return F.lit(True)


def _iban(run: Column) -> Column:
    """The IBAN at the start of a run of capitals, digits and single spaces, null without one: it ends where a word does
    and passes mod 97; of several the one of its country's length, else the longest."""
    parts = F.split(run, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " "))
    size = lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))
    passed = F.filter(starts, lambda x: F.when(size(x).between(15, 34), _confirmed("iban", x)).otherwise(False))
    usual = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return F.coalesce(F.get(F.filter(passed, lambda x: size(x) == F.try_element_at(usual, F.substring(x, 1, 2))), F.lit(0)), F.get(passed, F.size(passed) - 1))


def _iban_spans(heads: Column, runs: Column) -> Column:
    """The spans of `heads`, each to the end of the IBAN that it and its run hold."""
    tried = F.zip_with(heads, runs, lambda h, r: F.struct(_iban(F.concat(h["found"], r)).alias("found"), h["start"].alias("start")))
    return F.transform(F.filter(tried, lambda x: x["found"].isNotNull()), lambda x: F.struct(x["found"].alias("found"), x["start"].alias("start"), (x["start"] + F.length(x["found"])).alias("end")))


def kind_spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order (code points)."""
    found = match_places(text, kind.pattern)
    if kind.name == "iban":
        found = _iban_spans(found, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)))
    else:
        found = F.filter(found, lambda x: _confirmed(kind.name, x["found"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def scored(cut: Column, spans: Column) -> Column:
        def score(x: Column) -> Column:
            near = F.concat(between(cut, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), x["start"]), F.lit(" "), between(cut, x["end"], x["end"] + CONTEXT_CHARS))
            known = F.translate(near, UPPER, LOWER).rlike(rf"(?<![a-z])(?:{kind.words})")
            return F.round(F.lit(kind.score + kind.confirmed) + F.when(known, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)), 2)

        return F.filter(F.transform(spans, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score"))), lambda x: x["score"] >= THRESHOLD)

    possible = text.contains(kind.hint) if kind.hint in "@+" else text.rlike(kind.hint)
    return F.when(possible, once(found, lambda spans: F.when(F.size(spans) == 0, none).otherwise(once(chunks(text), lambda cut: scored(cut, spans))))).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with one array a kind named _<kind>, and `out`: all spans, by kind and then by start. Columns of docs with
    these names are replaced.

    Null and empty texts have none; repeated rows and null ids are rows like any other; an empty table gives an empty
    result. Kinds are looked for by themselves, so spans of two kinds may overlap; within a kind they are the leftmost that
    don't, but for IBANs, which are tried from every place where one may start. A match that its check refuses is dropped
    and not tried again shorter, but for IBANs, which may end at any word.
    """
    docs = docs.withColumns({f"_{k.name}": kind_spans(k, whole_text(text)) for k in KINDS})
    return docs.withColumn(out, F.concat(*[F.col(f"_{k.name}") for k in KINDS]))


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column) -> Column:
    """The text with its spans (not none; in order of start, then the longer first) replaced."""
    reach = running_maxima(F.transform(spans, lambda x: x["end"]))  # how far the spans up to each reach

    def pieces(cut: Column, reach: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            return F.when(x["start"] < before, F.lit("")).otherwise(F.concat(between(cut, before, x["start"]), F.lit("<"), x["kind"], F.lit(">")))

        return F.concat(F.array_join(F.transform(spans, part), ""), between(cut, F.element_at(reach, -1), F.length(text)))

    return once(chunks(text), lambda cut: once(reach, lambda r: pieces(cut, r)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by its kind in angle brackets; overlapping spans become one, named by
    the first. Null texts stay null; rows without a span are left as they are; columns named _spans or _<kind> go."""
    docs = with_spans(docs, text, "_spans")
    ordered = F.transform(F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind")))), lambda x: F.struct(x["start"].alias("start"), (-x["less"]).alias("end"), x["kind"].alias("kind")))
    docs = docs.withColumn(text, F.when(F.size("_spans") > 0, once(ordered, lambda spans: _redacted(F.col(text), spans))).otherwise(F.col(text)))
    return docs.drop("_spans", *[f"_{k.name}" for k in KINDS])
