"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Everything is a DataFrame expression; nothing leaves the JVM and nothing is exchanged.
Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``; the method adds ``iban``
(mod 97), and, where context words raise their score to ``KEEP_SCORE``, ``phone_local``
and ``ssn``.  Patterns are proposed leftmost and without overlap within a kind.  They are
written with possessive loops and start guards, which match what the plain patterns match
but neither recurse nor back up, however long a run of digits or letters is.

Places are code points, end exclusive.  No step of any expression copies what it has
gathered so far, so that time grows with the text, however many matches it holds.

Defined cases: a null text is empty; very long texts are read whole; rows are judged one
by one, so repeated rows give equal results; an empty table gives an empty result; other
columns, of any name, pass through ``redact`` and are not read by ``pii``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.toxicity import fresh

CONTEXT_CHARS = 40
KEEP_SCORE = 0.6
#: Matches, or spans, that one step of a sum goes over.
SLICE = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap pattern that any text with a match has
    valid: str  # SQL on the match m
    score: float
    context: str
    always: bool = True


KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "e-?mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", rf"m rlike '^(?:{_BYTE}[.]){{3}}{_BYTE}$'", 0.6, "ip|host|address|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", "length(translate(m, ' -', '')) between 13 and 19 and luhn_check(translate(m, ' -', ''))", 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "length(translate(m, '+ ().-', '')) between 9 and 15", 0.7, "tel|phone|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "aggregate(split(concat(substr(translate(m, ' ', ''), 5), substr(translate(m, ' ', ''), 1, 4)), ''), 0, (r, c) -> case when c = '' then r when c <= '9' then (r * 10 + cast(c as int)) % 97 else (r * 100 + ascii(c) - 55) % 97 end) = 1", 0.9, "iban|account|bank"),
    Kind("phone_local", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}", "true", 0.3, "tel|phone|call|mobile|fax", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", "true", 0.3, "ssn|social security", False),
)
BASE = tuple(k.name for k in KINDS[:4])


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _cut(text: str, kind: Kind) -> Column:
    """Gaps between matches and the matches after them; the last gap has none."""
    q = _quoted(kind.pattern)
    return F.expr(f"case when {text} rlike '{_quoted(kind.needs)}' then zip_with(split({text}, '{q}', -1), regexp_extract_all({text}, '{q}', 0), (gap, m) -> named_struct('m', m, 'gap', gap)) else array() end")


def _spans(kind: Kind, cut: str) -> Column:
    """Spans of one kind: gaps and matches summed up to places, in slices of ``SLICE`` that
    are shifted by what lies before them, so that no array grows match by match.  A slice
    begins with the ``CONTEXT_CHARS`` characters before it."""
    valid = kind.valid.replace("m rlike", "x.m rlike").replace("(m,", "(x.m,")
    n, at = CONTEXT_CHARS, f"k * {SLICE} + 1"
    before = f"if(k = 0, '', right(array_join(transform(slice({cut}, {at} - {n}, {n}), x -> concat(right(x.gap, {n}), right(x.m, {n}))), ''), {n}))"
    slices = f"""transform(if(size({cut}) > 1, sequence(0, (size({cut}) - 1) div {SLICE}), cast(array() as array<int>)), k -> aggregate(slice({cut}, {at}, {SLICE}),
        named_struct('at', 0, 'byte', 0, 'tail', {before}, 'out', cast(array() as array<struct<start:int,end:int,from:int,to:int,hint:boolean>>)),
        (a, x) -> named_struct('at', a.at + length(x.gap) + coalesce(length(x.m), 0), 'byte', a.byte + octet_length(x.gap) + coalesce(octet_length(x.m), 0),
            'tail', right(concat(a.tail, right(x.gap, {n}), coalesce(x.m, '')), {n}),
            'out', if(x.m is not null and {valid}, array_append(a.out, named_struct('start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.m),
                'from', a.byte + octet_length(x.gap), 'to', a.byte + octet_length(x.gap) + octet_length(x.m), 'hint', lower(right(concat(a.tail, right(x.gap, {n})), {n})) rlike '(?:{kind.context})')), a.out))))"""
    return F.expr(slices)


def _shifted(kind: Kind, slices: str) -> Column:
    """One array of all slices' spans, their places moved by what the slices before hold."""
    moved = f"""zip_with({slices}, aggregate({slices}, named_struct('at', 0, 'byte', 0, 'out', cast(array() as array<struct<at:int,byte:int>>)),
            (a, s) -> named_struct('at', a.at + s.at, 'byte', a.byte + s.byte, 'out', array_append(a.out, named_struct('at', a.at, 'byte', a.byte))), a -> a.out),
        (s, o) -> transform(s.out, x -> named_struct('kind', '{kind.name}', 'start', x.start + o.at, 'end', x.end + o.at, 'score', least(1.0D, {kind.score}D + if(x.hint, 0.3D, 0.0D)), 'from', x.from + o.byte, 'to', x.to + o.byte)))"""
    return F.expr(f"flatten({moved})")


def _bound(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """docs with columns, each computed once.  The optimizer writes what a projection names
    into every place that uses it, and into filters above, layer by layer; it does not
    look through an explode, here of one element."""
    held = fresh(docs, "pii_held")
    kept = [c for c in docs.columns if c not in columns]
    one = docs.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(held))
    return one.select(*kept, *(F.col(f"{held}.{n}").alias(n) for n in columns))


def _replaced(docs: DataFrame, text: str, spans: str, out: str, by: str) -> DataFrame:
    """docs with ``out``: the text with each span replaced by ``by``, SQL on the span x and
    on ``more``, the characters that spans before it have not covered; what an earlier span
    covers in part is only cut further.  Texts are cut by bytes, and places are summed up in
    slices, so that time grows with the text alone."""
    raw, line, top = (fresh(docs, f"pii_{n}") for n in ("raw", "line", "top"))
    sliced = f"if(size({line}) > 0, sequence(0, (size({line}) - 1) div {SLICE}), cast(array() as array<int>))"
    end = lambda a, b: f"named_struct('byte', greatest({a}.byte, {b}.byte), 'at', greatest({a}.at, {b}.at))"
    zero = "named_struct('byte', 0, 'at', 0)"
    docs = _bound(docs, {raw: F.col(text).cast("binary"), line: F.expr(f"array_sort(transform({spans}, s -> struct(s.start as start, s.end as end, s.kind as kind, s.from as from, s.to as to)))")})
    docs = _bound(docs, {top: F.expr(f"aggregate({sliced}, named_struct('now', {zero}, 'out', cast(array() as array<struct<byte:int,at:int>>)), (a, k) -> named_struct('now', {end('a.now', f"aggregate(slice({line}, k * {SLICE} + 1, {SLICE}), {zero}, (m, x) -> named_struct('byte', greatest(m.byte, x.to), 'at', greatest(m.at, x.end)))")}, 'out', array_append(a.out, a.now)))")})
    pieces = f"""transform({sliced}, k -> aggregate(slice({line}, k * {SLICE} + 1, {SLICE}), named_struct('byte', {top}.out[k].byte, 'at', {top}.out[k].at, 'out', cast(array() as array<string>)),
        (a, x) -> case when x.from >= a.byte then named_struct('byte', x.to, 'at', x.end, 'out', array_append(a.out, concat(cast(substring({raw}, a.byte + 1, x.from - a.byte) as string), {by.replace('more', '(x.end - x.start)')})))
                       when x.to > a.byte then named_struct('byte', x.to, 'at', x.end, 'out', array_append(a.out, {by.replace('more', '(x.end - a.at)') if 'more' in by else "''"})) else a end,
        a -> array_join(a.out, '')))"""
    whole = f"concat(array_join({pieces}, ''), cast(substring({raw}, {top}.now.byte + 1) as string))"
    return _bound(docs, {out: F.when(F.size(line) > 0, F.expr(whole)).otherwise(F.col(text))}).drop(raw, line, top)


def detect(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with ``out``: array of (kind, start, end, score, and from, to in bytes) by kind
    as listed, then start.  The kinds that the method adds are looked for in what the base
    kinds leave."""
    whole, rest = fresh(docs, "pii_text"), fresh(docs, "pii_rest")
    names = {k.name: fresh(docs, f"pii_{k.name}") for k in KINDS}

    def found(df: DataFrame, kinds: list[Kind], source: str) -> DataFrame:
        df = _bound(df, {names[k.name]: _cut(source, k) for k in kinds})
        df = _bound(df, {names[k.name]: _spans(k, names[k.name]) for k in kinds})
        return _bound(df, {names[k.name]: _shifted(k, names[k.name]) for k in kinds})

    df = found(docs.withColumn(whole, F.coalesce(F.col(text), F.lit(""))), [k for k in KINDS if k.name in BASE], whole)
    df = _bound(df, {out: F.concat(*(F.col(names[k]) for k in BASE))}).drop(*(names[k] for k in BASE))
    df = found(_replaced(df, whole, out, rest, "repeat('\\u0001', more)"), [k for k in KINDS if k.name not in BASE], rest)
    more = [F.expr(f"filter({names[k.name]}, s -> s.score >= {KEEP_SCORE}D)") for k in KINDS if k.name not in BASE]
    return _bound(df, {out: F.concat(F.col(out), *more)}).drop(whole, rest, *names.values())


def as_text(spans: str, only_base: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    chosen = f"filter({spans}, s -> s.kind in {BASE})" if only_base else spans
    return F.expr(f"array_join(transform({chosen}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(as_text("spans", True).cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of spans that overlap
    the first gives the name.  n_chars, where there is one, follows the text; a text
    without spans, null too, stays as it is."""
    spans, cut = fresh(docs, "spans"), fresh(docs, "cut")
    found = _replaced(detect(docs, out=spans), "text", spans, cut, "concat('<', upper(x.kind), '>')")
    some = F.size(spans) > 0
    out = found.withColumn("text", F.col(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)
