"""Plain Python versions of the operators, for tables small enough to hold."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    """The four base kinds of personal data: {kind: [(start, end)]}."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {kind: [m.span() for m in re.finditer(pattern, text) if valid(m[0])] for kind, (pattern, valid) in rules.items()}


def base_digest(text):
    found = base_spans(text)
    told = ",".join(f"{kind}:{a}:{b}" for kind, spans in found.items() for a, b in spans)
    return {f"n_{k}": len(v) for k, v in found.items()} | {"base_sha256": hashlib.sha256(told.encode()).hexdigest()}, told


def thue_morse(n):
    """Two texts of n letters (a power of two) that polynomials modulo 2**64 can't tell apart, whatever their base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
