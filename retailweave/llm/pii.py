"""Personal data spans, in DataFrame operations only.

Regular expressions propose spans kind by kind, leftmost and without overlap. Checks confirm them: four parts of at most
255, the Luhn sum of card numbers, the mod-97 sum of bank account numbers, digit counts. Words next to a span adjust its
score: words of its kind raise it, words of harmless numbers lower it. The base kinds (email, ip, card, phone) always
stay, whatever their score; the added kinds (iban, ssn, local_phone) need `THRESHOLD` and must not overlap a base span.

The patterns match what their plain forms match, but every character of a text is tried a bounded number of times:
a run is only entered at its start or where the last match ended, and repetition never gives back.

Spans are offsets in code points, the end exclusive. Defined cases: null is read as an empty text; empty texts have no
spans; other columns pass through, but for one with the result's name, which the result replaces; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clear_of, free_prefix

THRESHOLD = 0.5
NEAR = 40
RAISE, LOWER = 0.3, 0.3
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without this has no span of the kind
    valid: str  # SQL over `m`, the matched string
    score: float
    context: str
    base: bool


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> IF(i % 2 = 0, int(d), "
    "IF(int(d) < 5, int(d) * 2, int(d) * 2 - 9))), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"
)
_MOD97 = (
    "aggregate(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + int(c)) % 97 "
    "ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
)
_LOCAL = "A-Za-z0-9._%+-"

#: Kinds in the order in which spans with the same start are listed.
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        "true",
        0.8,
        "mail|contact|write|kontakt|correo|courriel",
        True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "[0-9]",
        r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(int(p), 0) <= 255)",
        0.6,
        r"\bip\b|address|host|server|login|from",
        True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?+[0-9])++",
        "[0-9]",
        f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
        0.9,
        "card|credit|debit|visa|master|karte|carte|tarjeta",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+",
        f"length({_DIGITS}) BETWEEN 9 AND 15",
        0.6,
        "tel|phone|call|mobil|fax|cell|anruf",
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3}+)?+)(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}",
        0.9,
        "iban|account|bank|konto|compte|cuenta",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]",
        "substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 1) <> '9' AND substring(m, 5, 2) <> '00' "
        "AND substring(m, 8, 4) <> '0000'",
        0.4,
        r"ssn|social|security|\btax\b|insurance",
        False,
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
        "[0-9][.-][0-9]",
        "true",
        0.4,
        "tel|phone|call|mobil|fax|cell|anruf",
        False,
    ),
)
HARMLESS = r"order|invoice|version|isbn|serial|article no|ticket"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidates(text: str, kind: Kind) -> str:
    """SQL: array of (start, end, m, near) of all matches.

    What lies between the matches gives the offsets. Running sums are taken in blocks, and blocks of blocks, as an array
    grows by copying. The one-element arrays bind a value that is used several times.
    """
    pattern = _literal(kind.pattern)
    pieces = (
        f"transform(array(split({text}, {pattern}, -1)), ps -> "
        f"zip_with(zip_with(ps, regexp_extract_all({text}, {pattern}, 0), (p, m) -> named_struct("
        f"'gap', bigint(length(p)), 'len', bigint(length(m)), 'm', m, 'before', right(p, {NEAR}))), "
        f"slice(ps, 2, size(ps)), (x, after) -> named_struct('gap', x.gap, 'len', x.len, 'm', x.m, "
        f"'near', concat(x.before, ' ', left(coalesce(after, ''), {NEAR})))))[0]"
    )
    blocks = f"transform(sequence(0, (size(l) - 1) div {_BLOCK}), b -> slice(l, b * {_BLOCK} + 1, {_BLOCK}))"
    sums = "transform(bs, x -> aggregate(x, 0L, (a, y) -> a + y.gap + coalesce(y.len, 0L)))"
    starts = f"aggregate({sums}, array(0L), (a, s) -> concat(a, array(element_at(a, -1) + s)))"
    inside = (
        "aggregate(x, named_struct('at', at0, 'out', cast(array() AS "
        "array<struct<start:bigint,stop:bigint,m:string,near:string>>)), "
        "(a, y) -> named_struct('at', a.at + y.gap + coalesce(y.len, 0L), 'out', concat(a.out, array(named_struct("
        "'start', a.at + y.gap, 'stop', a.at + y.gap + y.len, 'm', y.m, 'near', y.near)))), a -> a.out)"
    )
    spans = (
        f"flatten(transform(array({pieces}), l -> transform(array({blocks}), bs -> "
        f"flatten(zip_with(bs, {starts}, (x, at0) -> IF(x IS NULL, NULL, {inside}))))[0]))"
    )
    # the last start is the text's end and has no block
    spans = spans.replace(f"zip_with(bs, {starts}", f"zip_with(bs, slice({starts}, 1, size(bs))")
    return f"filter({spans}, x -> x.m IS NOT NULL)"


def _of_kind(text: str, order: int, kind: Kind) -> Column:
    """Array of confirmed spans of a kind with their scores."""
    found = (
        f"transform(filter({_candidates(text, kind)}, x -> exists(array(x.m), m -> {kind.valid})), x -> named_struct("
        f"'start', x.start, 'kind_order', {order}, 'stop', x.stop, 'kind', '{kind.name}', "
        f"'score', round(least(1D, greatest(0D, {kind.score}D "
        f"+ IF(lower(x.near) RLIKE {_literal(kind.context)}, {RAISE}D, 0D) "
        f"- IF(lower(x.near) RLIKE {_literal(HARMLESS)}, {LOWER}D, 0D))), 2)))"
    )
    empty = "cast(array() AS array<struct<start:bigint,kind_order:int,stop:bigint,kind:string,score:double>>)"
    return F.expr(f"IF({text} RLIKE {_literal(kind.hint)}, {found}, {empty})")


def find_pii(
    docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, result: str = "pii"
) -> DataFrame:
    """Adds `result`: (base, all), each an array of (start, kind_order, stop, kind, score) by start, then kind."""
    docs = clear_of(docs, result)
    name = free_prefix(docs)
    rows = docs.withColumn(f"{name}t", F.coalesce(F.col(text), F.lit("")))
    spans = {f"{name}{k.name}": _of_kind(f"{name}t", i, k) for i, k in enumerate(KINDS)}
    rows = rows.withColumns(spans)
    base = F.array_sort(F.concat(*[F.col(f"{name}{k.name}") for k in KINDS if k.base]))
    more = F.concat(*[F.col(f"{name}{k.name}") for k in KINDS if not k.base])
    rows = rows.withColumns({f"{name}base": base, f"{name}more": more})
    free = F.filter(
        f"{name}more",
        lambda s: (s["score"] >= threshold)
        & ~F.exists(f"{name}base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    rows = rows.withColumn(result, F.struct(F.col(f"{name}base").alias("base"), F.array_sort(F.concat(f"{name}base", free)).alias("all")))
    return rows.select(*docs.columns, result)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    one = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    )
    return F.array_join(one, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
