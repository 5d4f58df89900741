"""Personal data by candidate gradient boosting.

The base patterns (with their checks) find what is certain. Wide generators propose
further, overlapping spans: addresses with words for signs, numbers with other
separators or without their sign, long keys behind a name for one (kind "secret").
Boosted trees rate them by format and context; those over a threshold that was calibrated
on texts the trees didn't see are added, unless they overlap a span that is already there.

The trees learn from PLANTED made texts (see planted.py: values in forms that the base
patterns miss and look-alikes, each with a label of its own) and from the candidates of
about SAMPLE_DOCS documents drawn by hash over the whole table, SAMPLE_ROWS at most, the
first ones by hash: base spans in another writing are positive, candidates of forms that
fail a checksum or a range are negative. Texts are split whole between trees and
calibration, so no value is on both sides.

Patterns run only within maximal runs of the characters that they consist of, so the
time is linear in the text; addresses with numbers are found as chains of groups.

Cases: a null or empty text has no spans; offsets count code points; spans with one start
follow the order of kinds; repeated rows are searched one by one; an empty table gives an
empty result; extra columns aren't read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, planted
from .kernels import chunks

#: The base kinds in their order, then the kind that only the generators propose.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SAMPLE_DOCS, SAMPLE_ROWS, PLANTED, PRECISION = 30_000, 10_000, 8_000, 0.98

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]+")
#: The generators beyond the base patterns: kind and pattern, for runs of number signs.
_WIDE = (
    ("phone", re.compile(rb"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])")),
    ("card", re.compile(rb"(?<![0-9])[0-9]{4}(?:[\x20.-]{0,2}[0-9]{4}){2,3}(?:[\x20.-]?[0-9]{1,4})?(?![0-9])")),
    ("ip", re.compile(rb"(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])")),
)
#: For the text around signs that runs of number signs don't hold.
_APART = (("ip", re.compile(rb"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")), ("card", re.compile(rb"(?<![0-9])[0-9]{4}(?:/[0-9]{4}){3}(?![0-9])")))
_SECRET = re.compile(rb"(?![A-Za-z0-9])\.?[\"']?\x20?[:=]?\x20?[\"']?([A-Za-z0-9_+/=-]{16,128})(?![A-Za-z0-9])")
#: Names that stand before keys, and before other long words of letters and digits.
_NAMED = (b"token", b"key", b"secret", b"password", b"passwd", b"commit", b"sha1", b"checksum", b"serial", b"ref", b"batch", b"build", b"release")
_KEYED = re.compile(rb"(?i)token|key|secret|passw")
_AT = re.compile(rb"[\x20)\](\[](?:at|AT)[\x20)\](\[]")
_BEFORE_AT = re.compile(rb"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]?$")
_AFTER_AT = re.compile(rb"\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}|\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63})+")
_HINTS = re.compile(rb"\b(mail|e-mail|email|contact|write|call|tel|phone|fax|mobile|ip|host|server|card|visa|pay|paid|account|login|client|courriel|correo|karte|tarjeta|telefon|llame|address)\b", re.I)


#: Words that go with numbers of other kinds.
_OTHERS = (b"order", b"part", b"version", b"item", b"isbn", b"page", b"invoice", b"batch", b"serial", b"build", b"release", b"figure", b"commit", b"sha", b"checksum", b"ref", b"no.")


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


_NUMERIC = _table(b"0123456789 .()+-")
_DIGIT = _table(b"0123456789")
_LOCAL = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
_ADDRESS = _table(_LOCAL + b"@")


def luhn(digits: bytes) -> bool:
    odd = [d - 48 for d in digits[::-1]]
    return (sum(odd[::2]) + sum(2 * d - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def _runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask that cross no cut."""
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    begin[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def emails(run: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern in a run of its characters. The part
    before a sign is all that lies between it and the last match or sign."""
    start, at = 0, run.find(b"@")
    while at >= 0:
        found = _DOMAIN.match(run, at + 1) if at > start else None
        if found:
            yield start, found.end()
        start = found.end() if found else at + 1
        at = run.find(b"@", start)


def numbers(run: bytes) -> Iterator[tuple[str, int, int]]:
    for m in _CHAIN.finditer(run):
        # four groups are a match, and the next one starts with the group behind it
        groups = m[0].split(b".") if b"." in m[0] else ()
        at = m.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(d.lstrip(b"0")) <= 3 and int(d.lstrip(b"0") or 0) <= 255 for d in four):
                yield "ip", at, end
            at = end + 1
    for m in _CARD.finditer(run):
        d = b"".join(_DIGITS.findall(m[0]))
        if 12 <= len(d) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(run):
        if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            yield "phone", *m.span()


def wide(run: bytes) -> Iterator[tuple[str, int, int]]:
    for kind, pattern in _WIDE:
        for m in pattern.finditer(run):
            yield kind, *m.span()


def apart(flat: bytes) -> Iterator[tuple[str, int, int]]:
    """Spans whose signs lie outside of runs of number signs, and keys behind their names.
    Each is looked for only where its sign or a name occurs."""
    for sign, (kind, pattern) in zip((b"[.]", b"/"), _APART, strict=True):
        if sign in flat:
            for m in pattern.finditer(flat):
                yield kind, *m.span()
    low = flat.lower()
    for name in _NAMED:
        at = low.find(name)
        while at >= 0:
            if (m := _SECRET.match(flat, at + len(name))) and _DIGITS.search(m[1]):
                yield "secret", *m.span(1)
            at = low.find(name, at + len(name))


def spoken(flat: bytes) -> Iterator[tuple[str, int, int]]:
    """Addresses with words for signs; only looked for around such words."""
    past = 0
    for m in _AT.finditer(flat):
        after = _AFTER_AT.match(flat, m.end())
        if after and (before := _BEFORE_AT.search(flat[max(past, m.start() - 66) : m.start()])):
            yield "email", max(past, m.start() - 66) + before.start(), after.end()
            past = after.end()


def features(kind: str, text: bytes, a: int, b: int) -> list[float]:
    """Format and context of text[a:b]."""
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    groups = [len(g) for g in _DIGITS.findall(s)] or [0]
    letters = sum(65 <= (c & 0xDF) <= 90 for c in s)
    near = lambda c: 0.0 if not c else 1.0 if c[0] in b" \t\n" else 2.0 if c[0] in b".,;:)!?" else 3.0 if 48 <= c[0] <= 57 else 4.0
    near_words = before.lower()
    return [
        float(bool(_KEYED.search(near_words[-24:]))), float(near_words.rstrip(b" \"'")[-1:] in (b"=", b":")), float(any(w in near_words for w in _OTHERS)),
        float(ALL_KINDS.index(kind)), float(len(s)), float(sum(groups)), float(letters), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)),
        float(s.count(b".")), float(s.count(b"-")), float(s.count(b" ")), float(s.count(b"(")), float(s[:1] == b"+" or before[-1:] == b"+"), float(s.count(b"@")),
        float(len(set(s))), near(before[-1:]), near(after[:1]), float(len(_HINTS.findall(before))), float(max((int(g) for g in _DIGITS.findall(s)[:8] if len(g) < 4), default=0)), float(luhn(b"".join(_DIGITS.findall(s)))),
    ]


def candidates(part: pa.RecordBatch) -> Iterator[tuple[int, bytes, list, list]]:
    """(row, text, base spans, wide spans) of the rows with any; byte offsets."""
    column = pc.fill_null(part["text"], "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0] if len(column) else np.zeros(1, np.int64)
    flat = raw.tobytes()
    base: dict[int, list] = {}
    more: dict[int, list] = {}

    def put(where: dict, begin: int, found: Iterator) -> None:
        row = int(np.searchsorted(cuts, begin, "right")) - 1
        for kind, a, b in found:
            where.setdefault(row, []).append((kind, begin + a - int(cuts[row]), begin + b - int(cuts[row])))

    begin, end = _runs(_NUMERIC[raw], cuts)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    some = digits[end] - digits[begin] >= 4
    for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True):
        put(base, a, numbers(flat[a:b]))
        put(more, a, wide(flat[a:b]))
    if b"@" in flat:
        begin, end = _runs(_ADDRESS[raw], cuts)
        signs = np.concatenate([[0], np.cumsum(raw == 64)])
        some = signs[end] > signs[begin]
        for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True):
            put(base, a, (("email", x, y) for x, y in emails(flat[a:b])))
    around = chain(apart(flat), spoken(flat) if b"dot" in flat or b"DOT" in flat else ())
    for kind, a, b in around:
        row = int(np.searchsorted(cuts, a, "right")) - 1
        if b <= cuts[row + 1]:  # else it runs over the end of a text
            more.setdefault(row, []).append((kind, a - int(cuts[row]), b - int(cuts[row])))
    order = {k: i for i, k in enumerate(ALL_KINDS)}
    for row in sorted(base.keys() | more.keys()):
        sure = sorted(base.get(row, []), key=lambda x: (x[1], order[x[0]]))
        known = set(sure)
        extra = [x for x in dict.fromkeys(more.get(row, [])) if x not in known]
        yield row, flat[cuts[row] : cuts[row + 1]], sure, extra


def _altered(kind: str, s: bytes) -> list[bytes]:
    """A certain span as it might be written elsewhere."""
    if kind == "email":
        return [s.replace(b"@", b" (at) ").replace(b".", b" (dot) "), s.replace(b"@", b" at ").replace(b".", b" dot ")]
    if kind == "phone":
        return [re.sub(rb"^\+[0-9]{1,3}[\x20.-]?", b"", s)]
    if kind == "card" and s.isdigit():
        return [b"-".join(s[i : i + 4] for i in range(0, len(s), 4)), b".".join(s[i : i + 4] for i in range(0, len(s), 4))]
    return []


def _fails(kind: str, s: bytes) -> bool:
    """Whether a form of the kind breaks a check that every such value passes."""
    groups = _DIGITS.findall(s)
    return kind == "card" and not luhn(b"".join(groups)) or kind == "ip" and any(len(g.lstrip(b"0")) > 3 or int(g.lstrip(b"0") or 0) > 255 for g in groups)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            groups, rows = [], []
            ids = part["h"].to_pylist()
            for row, text, sure, extra in candidates(part):
                made = []
                for kind, a, b in sure:
                    for s in _altered(kind, text[a:b]):
                        made.append([*features(kind, text[max(0, a - 40) : a] + s + text[b : b + 20], min(a, 40), min(a, 40) + len(s)), 1.0])
                for kind, a, b in extra:
                    if _fails(kind, text[a:b]) and not any(a < y and x < b for _, x, y in sure):
                        made.append([*features(kind, text, a, b), 0.0])
                rows += made
                groups += [ids[row]] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["h", "x"])


def planted_rows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """Features, labels and groups of the candidates that the generators propose in made
    texts, and for each personal value there whether it was proposed at all."""
    made = planted.examples(n, seed)
    x, y, groups, proposed = [], [], [], []
    for i, (text, kind, (a, b), good) in enumerate(made):
        raw = text.encode()
        found = [c for _, _, sure, extra in candidates(pa.RecordBatch.from_arrays([pa.array([text])], ["text"])) for c in [*sure, *extra]]
        hits = [c for c in found if c[0] == kind and c[1] < b and a < c[2]]
        if good:
            proposed.append(bool(hits))
        for k, s, e in hits:
            x.append(features(k, raw, s, e))
            y.append(float(good))
            groups.append(i)
    return np.array(x, float).reshape(len(y), -1), np.array(y), np.array(groups, np.int64), proposed


def learn(docs: DataFrame, precision: float = PRECISION) -> tuple[boosting.Boosted, float]:
    """The trees and their threshold. docs: doc_id, text."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    hashed = docs.select(F.xxhash64("doc_id", F.lit(7)).alias("h"), "text")
    drawn = hashed.where(F.pmod("h", F.lit(1_000_000)) < max(1, round(share * 1_000_000)))
    found = drawn.mapInArrow(_examples, "h long, x array<double>").orderBy("h", "x").limit(SAMPLE_ROWS).collect()
    x, y, group, _ = planted_rows(PLANTED, 1)
    later = group % 3 == 2
    if found:
        own = np.array([r["x"] for r in found], float)
        x, y = np.concatenate([x, own[:, :-1]]), np.concatenate([y, own[:, -1]])
        later = np.concatenate([later, np.array([r["h"] % 3 == 2 for r in found])])
    model = boosting.fit(x[~later], y[~later])
    return model, boosting.calibrate(model, x[later], y[later], precision)


SPANS = "doc_id long, redacted string, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(model: boosting.Boosted, threshold: float):
    order = {k: i for i, k in enumerate(ALL_KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                out: list[list] = [[] for _ in range(len(part))]
                clean: list = [None] * len(part)
                for row, text, sure, extra in candidates(part):
                    spans = [(k, a, b, True) for k, a, b in sure]
                    if extra and threshold <= 1:
                        p = model.probability(np.array([features(k, text, a, b) for k, a, b in extra]))
                        for i in np.lexsort(([a for _, a, _ in extra], -p)).tolist():
                            k, a, b = extra[i]
                            if p[i] >= threshold and not any(a < y and x < b for _, x, y, _ in spans):
                                spans.append((k, a, b, False))
                    at = sorted({x for _, a, b, _ in spans for x in (a, b)})
                    inside = np.frombuffer(text, np.uint8) & 0xC0 == 0x80
                    back = np.concatenate([[0], np.cumsum(inside)])
                    point = {x: x - int(back[x]) for x in at}
                    clean[row] = redact(text, spans)
                    out[row] = [{"kind": k, "start": point[a], "end": point[b], "base": s} for k, a, b, s in sorted(spans, key=lambda x: (x[1], order[x[0]]))]
                redacted = pc.coalesce(pa.array(clean, pa.binary()).cast(pa.string()), pc.fill_null(part["text"].cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([part["doc_id"], redacted, pa.array(out, _SPAN_TYPE)], ["doc_id", "redacted", "spans"])

    return run


def find(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: doc_id, the redacted text (each span replaced by its kind
    in brackets) and the spans (kind, start, end, base)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_find(*learn(source, precision)), SPANS)


def redact(text: bytes, spans: list[tuple]) -> bytes:
    """The text with each span (kind, start, end, ...) replaced by its kind; of
    overlapping spans the first one names what covers them all."""
    out, past = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda x: x[1]):
        if a >= past:
            out += [text[past:a], f"[{kind}]".encode()]
        past = max(past, b)
    return b"".join([*out, text[past:]])
