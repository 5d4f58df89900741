"""Made texts with personal data and with what resembles it, for learning and for tests.

No labelled personal data exist where the trees are trained, so evidence comes from a
grammar: values of each kind in forms that the base patterns miss, among words that go
with them, and numbers of other kinds (dates, versions, prices, order numbers, digests)
among theirs; a fifth of the values stand among plain words. Texts of one seed are the
same everywhere. Numbers that only their cue
tells apart occur with both kinds of cue, so the context has to be learnt too."""

from __future__ import annotations

import random

KINDS = ("email", "ip", "card", "phone", "secret")
_NAMES = ("jane", "omar", "li.wei", "anna", "k.novak", "sales", "info", "peter", "maria.diaz", "tom")
_SITES = ("example", "mailbox", "site", "post", "firma", "correo", "uni", "acme")
_ENDS = ("org", "com", "net", "de", "fr", "es", "co.uk")
_FILL = ("the", "and", "report", "der", "une", "casa", "on", "list", "und", "le", "with", "see", "from", "table", "page", "que", "was", "mit", "est", "of")

#: Cues before a value of a kind, and before numbers that are none.
_GOOD = {
    "email": ("mail me at", "contact:", "write to", "e-mail", "courriel", "correo:"),
    "ip": ("host", "server", "from address", "ip", "client ip:", "login from"),
    "card": ("card", "card number:", "visa", "paid with", "Karte", "tarjeta"),
    "phone": ("call", "tel.", "phone:", "fax", "mobile", "Telefon", "llame al"),
    "secret": ("token =", "api_key:", "password =", "secret:", "auth_token =", "passwd:"),
}
_BAD = ("order", "part no.", "version", "item", "ISBN", "pages", "invoice", "batch", "serial", "build", "release", "figure", "commit", "sha1", "checksum:", "ref.")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _valid(rng: random.Random, n: int) -> str:
    """n digits whose checksum holds."""
    d = rng.choice("3456") + _digits(rng, n - 2)
    total = sum(x if k % 2 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d))))
    return d + str(-total % 10)


def _value(rng: random.Random, kind: str) -> str:
    """A value that the base patterns don't find."""
    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)")))
        return rng.choice(_NAMES) + at + rng.choice(_SITES) + dot + rng.choice(_ENDS).split(".")[0]
    if kind == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice((" . ", "[.]")).join(parts)
    if kind == "card":
        d = _valid(rng, 16)
        return rng.choice((".", "  ", "/")).join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = str(rng.randint(200, 989)), str(rng.randint(200, 989)), _digits(rng, 4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b}-{c}"))
    n = rng.choice((20, 32, 40))
    word = "".join(rng.choice("0123456789abcdef" if n != 20 else "ABCDEFGHJKMNPQRSTUVWXYZ0123456789abcdefghkmnpqrstuvwxyz") for _ in range(n))
    return f'"{word}"' if rng.random() < 0.5 else word


def _lookalike(rng: random.Random, kind: str) -> str:
    """What a generator of the kind takes for one."""
    if kind == "email":
        return rng.choice(("look at the dot on", "at each dot in", "stand at point dot one"))
    if kind == "ip":
        return " . ".join(str(rng.randint(1, 40)) for _ in range(4))
    if kind == "card":
        d = _digits(rng, 16)
        return rng.choice((".", "  ", "/")).join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return rng.choice((f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"19{a[:2]}-{b}-{c[:3]}"))
    return "".join(rng.choice("0123456789abcdef") for _ in range(40))


def examples(n: int, seed: int) -> list[tuple[str, str, tuple[int, int], bool]]:
    """n rows (text, kind, the value's offsets, whether it is personal data)."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind, good = KINDS[i % len(KINDS)], rng.random() < 0.5
        value = _value(rng, kind) if good else _lookalike(rng, kind) if rng.random() < 0.7 else _value(rng, kind) if kind in ("phone", "secret") else _lookalike(rng, kind)
        cue = rng.choice(_FILL) if rng.random() < 0.2 else rng.choice(_GOOD[kind]) if good else rng.choice(_BAD)
        before, after = (" ".join(rng.choice(_FILL) for _ in range(rng.randint(2, 9))) for _ in range(2))
        lead = f"{before} {cue} "
        mark = 1 if value[:1] == '"' else 0
        out.append((f"{lead}{value} {after}", kind, (len(lead) + mark, len(lead) + len(value) - mark), good))
    return out
