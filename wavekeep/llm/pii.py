"""Personal data in text, found with SQL functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for account numbers,
ranges for addresses and social security numbers), and words near a span raise or lower its score.

Base kinds are email, ip, card and phone: leftmost matches that do not overlap within a kind; a match
that fails its check is dropped. They are kept whatever their score. The method's own kinds (iban,
ssn, mac, secret) are kept from ``threshold`` on. Every pattern is linear in the text: runs are
possessive and a match starts only where a run of its characters starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name

BASE = ("email", "ip", "card", "phone")
WINDOW = 48  # characters before a span that count as near it; after it half as many do
DOUBT = r"\b(?:example|sample|dummy|fake|placeholder|version|isbn|serial|invoice|part no|beispiel|exemple|ejemplo)\b"


@dataclass(frozen=True)
class Kind:
    """gate: a cheap test that a text with a match passes. check: SQL over the match ``m``. score: before context."""

    name: str
    gate: str
    pattern: str
    check: str
    score: float
    context: str


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
_MOD97 = (
    # letters become 10 to 35, nine digits at a time
    "aggregate(transform(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), c -> if(c rlike '[A-Z]', cast(ascii(c) - 55 as string), c)),"
    " 0L, (r, d) -> if(d = '', r, (r * if(length(d) = 2, 100, 10) + cast(d as bigint)) % 97)) = 1"
)
#: Countries by the length of their account numbers.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{x.replace(' ', '|')})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, x in IBANS.items())
#: Of other countries as long as it goes, but not into a number of a known one.
_OTHER_IBAN = rf"(?!{'|'.join(IBANS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_IBAN})) ?+[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
KINDS = (
    Kind("email", "instr({t}, '@') > 0", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, r"\b(?:e-?mail|mail|contact|write|reach|courriel|correo)"),
    Kind("ip", "{t} rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"m rlike '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'", 0.6, r"\b(?:ip|address|host|server|login|client|adresse)\b"),
    Kind("card", "{t} rlike '[0-9][ -]?[0-9]'", r"[0-9](?:[ -]?+[0-9])++", "length(translate(m, ' -', '')) between 14 and 19 and luhn_check(translate(m, ' -', ''))", 0.8, r"\b(?:card|visa|credit|debit|amex|mastercard|carte|karte|tarjeta)"),
    Kind("phone", "instr({t}, '+') > 0", r"\+[0-9][ ().0-9-]+[0-9]", "length(translate(m, '+ ().-', '')) between 10 and 15", 0.6, r"\b(?:phone|tel|call|mobile|fax|whatsapp|telefon|appel)"),
    Kind("iban", "{t} rlike '[A-Z]{2}[0-9]{2}'", rf"(?<![A-Za-z0-9])(?:{_IBAN}|{_OTHER_IBAN})", "length(replace(m, ' ', '')) between 15 and 34 and " + _MOD97.format(x="replace(m, ' ', '')"), 0.9, r"\b(?:iban|bank|account|konto|compte|cuenta)"),
    Kind("ssn", "{t} rlike '[0-9]-[0-9]{2}-[0-9]'", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "not m rlike '^(000|666|9)|-00-|-0000$'", 0.6, r"\b(?:ssn|social|security|tax)\b"),
    Kind("mac", "{t} rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{2}:'", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])", "true", 0.7, r"\b(?:mac|device|wlan|ethernet)\b"),
    Kind("secret", "{t} rlike 'AKIA|ghp_|sk-|xox[abp]-|AIza|BEGIN [A-Z ]*PRIVATE KEY'", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])|sk-[0-9A-Za-z_-]{20,}+|xox[abp]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-]))|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true", 0.9, r"\b(?:key|secret|token|password)"),
)


def _quote(x: str) -> str:
    return "r'" + x + "'" if "'" not in x else 'r"' + x + '"'


def _spans(t: str, m: str, p: str, kind: Kind, threshold: float) -> str:
    """SQL for the confirmed spans of one kind. m: its matches; p: the pieces between them. A match's
    start is the length of all pieces up to it and of all matches before it: sums of blocks of 128 are added up
    once, so a match costs at most 128 additions."""
    step = f"transform({m}, (x, i) -> length(x) + length({p}[i]))"
    blocks = f"transform(sequence(0, (size({m}) - 1) div 128), b -> aggregate(slice(steps, b * 128 + 1, 128), 0, (s, x) -> s + x))"
    sums = "transform(blocks, (x, b) -> aggregate(slice(blocks, 1, b), 0, (s, x) -> s + x))"
    at = f"sums[cast(i div 128 as int)] + aggregate(slice(steps, (i div 128) * 128 + 1, i % 128), 0, (s, x) -> s + x) + length({p}[i])"
    # steps, blocks and sums are bound by transforms over arrays of one element
    placed = f"flatten(transform(array({step}), steps -> flatten(transform(array({blocks}), blocks -> flatten(transform(array({sums}), sums -> transform({m}, (m, i) -> struct(m as m, {at} as start))))))))"
    around = f"lower(concat(substr({t}, greatest(1, x.start + 1 - {WINDOW}), least({WINDOW}, x.start)), ' ', substr({t}, x.start + length(x.m) + 1, {WINDOW // 2})))"
    score = f"{kind.score} + if({around} rlike {_quote(kind.context)}, 0.1, 0.0) - if({around} rlike {_quote(DOUBT)}, 0.1, 0.0)"
    rank = BASE.index(kind.name) if kind.name in BASE else len(BASE) + [k.name for k in KINDS].index(kind.name)
    found = f"transform(filter({placed}, x -> exists(array(x.m), m -> {kind.check})), x -> struct(x.start as start, {rank} as rank, x.start + length(x.m) as end, '{kind.name}' as kind, cast({score} as double) as score, x.m as value))"
    return found if kind.name in BASE else f"filter({found}, x -> x.score >= {threshold})"


def spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.65, out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out``: an array of (start, rank, end, kind, score, value) by start, then kind.

    Starts count code points from 0; ends are exclusive. A null or empty text has no spans. All other
    columns are kept as they are (``out`` gets underscores in front if taken); repeated rows repeat
    their spans; a text with very many matches is handled within its row.
    """
    out, t = free_name(docs, out), free_name(docs, "pii_t")
    kept = list(docs.columns)
    rows = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    cell = "array<struct<start int, rank int, end int, kind string, score double, value string>>"
    for k in KINDS:
        rows = rows.withColumn(f"{t}_m_{k.name}", F.expr(f"if({k.gate.replace('{t}', t)}, regexp_extract_all({t}, {_quote(k.pattern)}, 0), cast(array() as array<string>))"))
    for k in KINDS:
        rows = rows.withColumn(f"{t}_p_{k.name}", F.expr(f"if(size({t}_m_{k.name}) > 0, split({t}, {_quote(k.pattern)}, -1), cast(array() as array<string>))"))
    for k in KINDS:
        rows = rows.withColumn(f"{t}_s_{k.name}", F.expr(f"if(size({t}_m_{k.name}) > 0, {_spans(t, f'{t}_m_{k.name}', f'{t}_p_{k.name}', k, threshold)}, cast(array() as {cell}))"))
    every = F.array_sort(F.concat(*[F.col(f"{t}_s_{k.name}").cast(cell) for k in KINDS]))
    return rows.select(*kept, every.alias(out))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.65) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets; of spans that overlap,
    the first is replaced. A null text stays null."""
    name = free_name(docs, "pii_spans")
    rows = spans(docs, text_col, threshold, name)
    step = (
        f"aggregate({name}, struct('' as done, 0 as at), (a, x) -> if(x.start < a.at, a, struct(concat(a.done, substr(`{text_col}`, a.at + 1, x.start - a.at), '<', x.kind, '>') as done, x.end as at)),"
        f" a -> concat(a.done, substr(`{text_col}`, a.at + 1)))"
    )
    return rows.withColumn(text_col, F.expr(step)).drop(name)


def digest(rows: DataFrame, name: str = "spans", id_col: str = "doc_id") -> DataFrame:
    """The columns of op1 from those of ``spans``."""

    def said(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    every = F.col(name)
    base = F.filter(every, lambda s: s["rank"] < len(BASE))
    return rows.select(
        F.col(id_col).alias("doc_id"),
        *[F.expr(f"cast(size(filter(`{name}`, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("risk"),
    )
