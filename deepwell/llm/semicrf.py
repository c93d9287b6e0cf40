"""Personal data and secrets: a semi-Markov conditional random field over segments.

``find_private(docs)`` returns one row per entity:

    doc_id BIGINT, start INT, stop INT (characters of the text), kind STRING, score DOUBLE

A segmentation of the tokens scores the sum of its segments' weighted features and of transition weights
between neighbouring kinds. Features see the whole candidate span: its shape, lengths, checksum and address
tests, hexadecimal and opaque runs, a keyword before it, and what else stands before and after it. Dynamic programming
over segment ends picks boundaries and kinds jointly. A candidate starts and ends on a token that isn't white space, lies
in one line and has at most ``MAX_TOKENS`` tokens of any length; beyond that length assignments, keys with a known
prefix, addresses, values after a keyword and long runs without blanks are candidates as a whole, and a private key in
PEM is one token with all its lines. ``score`` is the entity's gain over reading its tokens as outside.

Every candidate has a score. One that holds no mark (a digit, an @, or one of the patterns named above) has the feature
``plain`` alone; so all of them score alike, and ``never_plain`` compares that score with every way of reading the same
tokens as outside, for all neighbours. Where it always loses, as under the trained weights, no best segmentation holds a
plain span, and only the stretches of ``MAX_TOKENS`` words around marks need the program: the result is that over the
whole text. Under other weights the program runs over whole texts with all candidates.

The weights are trained here, by regularised conditional likelihood (forward-backward, AdaGrad) on generated
sentences: each kind in many formats, and look-alikes (versions, dates, prices, sums, times, code, digests).

Kinds: EMAIL, PHONE, IP (versions 4 and 6), CARD, SECRET (API keys, private keys, and assignments of passwords or
tokens), SSN, IBAN.

Defined cases: null, empty and mark-free texts have no entity; a null doc_id is reported as null; repeated
rows are reported each; ties go to the longer segment, then the earlier kind; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
MAX_TOKENS = 16
LONG = 24
_PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"
_TOKEN = re.compile(_PEM + r"|[^\W_]+|[^\S\n]+|\n|.", re.DOTALL)
_TRIGGER = re.compile(r"[0-9@]")
_RUNS = re.compile(r"(.)\1+")
_SHAPE = str.maketrans(string.digits + string.ascii_lowercase + string.ascii_uppercase, "9" * 10 + "a" * 26 + "A" * 26)
_EMAIL = re.compile(r"[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_NAMES = r"password|passwd|pwd|passphrase|token|secret|bearer|credential|api[_-]?key|access[_-]?key|auth(?:orization)?"
_ASSIGN = re.compile(rf"(?i)({_NAMES})\s*[=:]\s*[\"']?([\w+/.~$!#%^&*-]{{6,}}=*)[\"']?")
_PHONE = re.compile(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)|\d{2,4})([ .-]\d{2,4}){1,4}")
_PREFIX = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|sk-|xox[abprs]-|AIza|npm_|hf_"
_KEY = re.compile(rf"({_PREFIX})[A-Za-z0-9_-]{{12,}}")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?")
#: Where secrets are in a text; assignments may overlap (``secret: password=...``).
_ASSIGNED = re.compile(rf"(?<![^\W_])(?=((?ai:{_NAMES})[^\S\n]*[=:][^\S\n]*[\"']?[\w+/.~$!#%^&*-]{{6,}}=*[\"']?))")
_KEYED = re.compile(r"(?<![^\W_])" + _KEY.pattern)
#: What stands after a secret's name and at most a word between, and long runs without blanks or quotes.
_AFTER = re.compile(rf"(?<![^\W_])(?ai:{_NAMES})(?:[^\S\n]+(?:is|was|of))?[^\S\n]*[:=]?[^\S\n]*[\"']?")
_VALUE = re.compile(r"[^\s\"'<>,;(){}\[\]]{6,}")
_OPAQUE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LONG},}}")
#: After a value that isn't whole.
_GOES_ON = re.compile(r"[\w+/~$#%^&*=-]|[.!][\w+/~$#%^&*=-]")
#: In the lower-case bytes of a text, one of these is in every pattern above that needs neither a digit nor an @.
_HINTS = (b"password", b"passwd", b"pwd", b"passphrase", b"token", b"secret", b"bearer", b"credential", b"apikey", b"api_", b"api-", b"accesskey", b"access_", b"access-", b"auth", b"akia", b"asia", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"sk_", b"sk-", b"xox", b"aiza", b"npm_", b"hf_", b"private key", b"::")


def tokenise(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _ipv6(span: str) -> bool:
    groups = [g for g in span.split(":") if g]
    if len(groups) < 2 or not _IPV6.fullmatch(span):
        return False
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return len(groups) >= 3 or any(c.isdigit() for c in span)


def _opaque(span: str) -> list[str]:
    """Of a run of letters, digits and joints that is no word, number or digest."""
    if not re.fullmatch(r"[A-Za-z0-9+/_=.~-]{12,}", span) or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+|\d[\d.-]*|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", span):
        return []
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in span]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if not (2 in kinds and (0 in kinds or 1 in kinds)) and 5 * turns < len(span):
        return []
    return ["opaque", f"turns={min(9, 20 * turns // len(span))}", "opaque long" if len(span) >= LONG else "opaque short", "opaque mixed" if 2 in kinds and (0 in kinds or 1 in kinds) else "opaque letters"]


PLAIN = ("plain",)


def span_features(span: str, before: str, after: str, named: bool = False) -> tuple[str, ...]:
    """Of the whole segment ``span``, the character before it and the two after it, and whether a secret's name is before it."""
    return (_kept_features if len(span) <= 96 else _features)(span, before, after, named)


def _features(span: str, before: str, after: str, named: bool) -> tuple[str, ...]:
    digits = "".join(c for c in span if "0" <= c <= "9")
    shape = _RUNS.sub(r"\1", span.translate(_SHAPE))
    out = ["bias"]
    if re.fullmatch(_PEM, span):
        return ("bias", "is pem")
    email, assigned, key = _EMAIL.fullmatch(span), _ASSIGN.fullmatch(span), _KEY.fullmatch(span)
    v6 = _ipv6(span) if ":" in span else False
    opaque = [] if email or assigned or key or v6 else _opaque(span)
    named = named and bool(_VALUE.fullmatch(span))
    if not (email or assigned or key or v6 or opaque or named):  # what is in these is arbitrary
        out += [f"digits={min(len(digits), 20)}", f"length={min(len(span) // 4, 12)}", "shape=" + (shape if len(shape) <= 9 else "long")]
    out.append("before=" + ("edge" if not before else "space" if before[-1].isspace() else "word" if before[-1].isalnum() else "open" if before[-1] in "([{\"'<:" else "mark"))
    out.append("after=" + ("edge" if not after else "space" if after[0].isspace() else "word" if after[0].isalnum() or after[0] == "_" else "joined" if after[0] in ".-@" and after[1:].isalnum() else "stop" if after[0] in ".,;:!?)]}\"'>" else "mark"))
    if span[-1] in ".,;:!?-=@" and not assigned:
        out.append("ends in mark")
    if not (span[0].isalnum() or span[0] in "+(" or v6):
        out.append("starts in mark")
    if " " in span:
        out.append("blank")
    if email:
        out.append("is email")
    if (m := _IP.fullmatch(span)) and all(int(x) < 256 for x in m.groups()):
        out.append("is ip")
    if v6:
        out.append("is ipv6")
    cut = bool(_GOES_ON.match(after)) and span[-1] not in "\"'"
    if assigned:
        out.append("assignment cut" if cut else "is assignment" + (" quoted" if span[-1] in "\"'" else ""))
    if key:
        out.append("key cut" if cut else "is key")
    if named:
        odd = bool(digits) and any(c.isalpha() for c in span)
        out.append("named cut" if cut else "named " + ("opaque" if opaque else "odd" if odd else "digits" if digits else "word"))
    out += opaque
    if _PHONE.fullmatch(span):
        out += ["is phone", f"is phone {len(digits) if 7 <= len(digits) <= 15 else 'odd'}"]
        if span[0] in "+(":
            out.append("phone mark")
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}([ -]\d{4}){2,3}([ -]\d{1,3})?", span):
        out += ["card length", "luhn" if luhn(digits) else "no luhn", f"card group {digits[0]}"]
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", span):
        out.append("is ssn")
    if _IBAN.fullmatch(span):
        code = span.replace(" ", "")
        ok = int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
        out.append("iban ok" if ok else "iban bad")
    if re.fullmatch(r"[0-9a-f]{16,}", span):
        out.append("hexadecimal")
    return tuple(out)


_kept_features = lru_cache(maxsize=1 << 14)(_features)


class SemiCrf:
    def __init__(self, weights: dict[tuple[str, int], float], moves: np.ndarray):
        """``weights``: by feature and kind (0: outside); ``moves``: (kind before, kind)."""
        self.weights, self.moves = weights, moves
        self._never: bool | None = None
        self.columns: dict[str, np.ndarray] = {}
        for (feature, kind), w in weights.items():
            self.columns.setdefault(feature, np.zeros(len(KINDS) + 1))[kind] = w

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(KINDS) + 1)
        for f in features:
            if (c := self.columns.get(f)) is not None:
                total += c
        return total

    def never_plain(self) -> bool:
        """Whether no best segmentation holds a plain span: its tokens read as outside score more, whatever the neighbours."""
        if self._never is None:
            plain, outside = self.score(PLAIN), self.columns.get("outside", np.zeros(len(KINDS) + 1))[0]
            m = self.moves
            n = np.arange(1, MAX_TOKENS + 1)
            least = float((n * outside + (n - 1) * m[0, 0]).min())
            as_entity = m[:, 1:, None] + plain[1:][None, :, None] + m[1:, :][None]  # (before, kind, after)
            as_outside = m[:, 0][:, None, None] + least + m[0, :][None, None, :]
            last = (m[:, 1:] + plain[1:]).max(1) < m[:, 0] + least  # at the text's end
            self._never = bool((as_entity < as_outside).all() and last.all())
        return self._never

    def segments(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, stop, kind 1.., gain) of the best segmentation's entities."""
        tokens, spans = candidates(text, plain=not self.never_plain())
        n = len(tokens)
        by_end: dict[int, list] = {}
        for a, b, features in spans:
            by_end.setdefault(b, []).append((a, self.score(features)))
        outside = self.columns.get("outside", np.zeros(len(KINDS) + 1))[0]
        best = np.full((n + 1, len(KINDS) + 1), -math.inf)
        back: list[dict[int, tuple[int, int, float]]] = [{} for _ in range(n + 1)]
        best[0, 0] = 0
        for b in range(1, n + 1):
            came = best[b - 1] + self.moves[:, 0]
            k = int(came.argmax())
            best[b, 0], back[b][0] = came[k] + outside, (b - 1, k, 0.0)
            for a, scores in sorted(by_end.get(b, ()), key=lambda x: x[0]):
                reach = best[a][:, None] + self.moves
                k = reach.argmax(0)
                for kind in range(1, len(KINDS) + 1):
                    v = reach[k[kind], kind] + scores[kind]
                    if v > best[b, kind]:
                        best[b, kind], back[b][kind] = v, (a, int(k[kind]), float(scores[kind] - outside * (b - a)))
        out = []
        kind, b = int(best[n].argmax()), n
        while b:
            a, before, gain = back[b][kind]
            if kind:
                out.append((tokens[a][0], tokens[b - 1][1], kind, gain))
            b, kind = a, before
        return out[::-1]


def marked(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans that are candidates as a whole, and where values after a secret's name start."""
    found = [m.span(1) for m in _ASSIGNED.finditer(text)] + [m.span() for m in _KEYED.finditer(text)]
    found += [m.span() for m in _EMAIL.finditer(text)] if "@" in text else []
    found += [m.span() for m in _IPV6.finditer(text) if _ipv6(m.group())] + [m.span() for m in _OPAQUE.finditer(text)] + [m.span() for m in re.finditer(_PEM, text)]
    named = []
    for m in _AFTER.finditer(text):
        if m.end() < len(text) and (value := _VALUE.match(text, m.end())) and not text[m.end() - 1].isalnum():
            named.append(m.end())
            found.append(value.span())
    return found, named


def candidates(text: str, plain: bool = True) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens, and the spans (first token, token after the last, features) that may be entities."""
    tokens = tokenise(text)
    if not tokens:
        return [], []
    begins = [a for a, _ in tokens]
    found, named = marked(text)
    whole = {(bisect_right(begins, a) - 1, bisect_right(begins, b - 1)) for a, stop in found for b in _ends(text, a, stop) if a < b}
    secret, names = {i for i, _ in whole}, set(named)
    trigger = np.concatenate([[0], np.cumsum([i in secret or bool(_TRIGGER.search(text, a, b)) for i, (a, b) in enumerate(tokens)])]).tolist()
    white = [text[a].isspace() for a, _ in tokens]
    line = [text[a] == "\n" for a, _ in tokens]
    spans = []

    def add(i: int, j: int) -> None:
        start, stop = tokens[i][0], tokens[j - 1][1]
        spans.append((i, j, span_features(text[start:stop], text[max(0, start - 1) : start], text[stop : stop + 2], start in names)))

    for i in range(len(tokens)):
        if white[i]:
            continue
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            if line[j]:
                break
            if white[j]:
                continue
            if trigger[j + 1] != trigger[i]:
                add(i, j + 1)
            elif plain:
                spans.append((i, j + 1, PLAIN))
    for i, j in sorted(whole):
        if j - i > MAX_TOKENS and not white[i] and not white[j - 1]:
            add(i, j)
    return tokens, spans


def _ends(text: str, start: int, stop: int) -> set[int]:
    """Where a secret may end: with or without a quote, and with or without a sentence's marks."""
    whole = text[start:stop]
    bare = whole.rstrip("\"'")
    return {stop, start + len(bare), start + len(bare.rstrip("./+-!:?"))}


# --- training -------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    w = "".join(r.choice(["an", "er", "th", "in", "st", "ou", "ra", "le", "mi", "co", "ñó", "éa", "über", "ch", "de", "s", "ti"]) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.15 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _entity(r: random.Random, kind: str) -> str:
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if kind == "EMAIL":
        user = r.choice([_ascii(r), f"{_ascii(r)}.{_ascii(r)}", f"{_ascii(r)}.{_digits(r, 2)}", f"{_ascii(r)}_{_digits(r, 3)}", f"{_ascii(r)}+{_ascii(r)}"])
        return user + "@" + r.choice(["", "mail.", f"m{_digits(r, 1)}."]) + _ascii(r) + r.choice(["", _digits(r, 1)]) + "." + r.choice(["com", "org", "net", "de", "fr", "io", "example.com", "co.uk"])
    if kind == "PHONE":
        a, b, c = str(r.randint(2, 9)) + _digits(r, 2), _digits(r, 3), _digits(r, 4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+{r.randint(20, 99)} {_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"+{r.randint(20, 99)} {_digits(r, 3)} {_digits(r, 7)}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"])
    if kind == "IP":
        if r.random() < 0.6:
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        groups = [f"{r.randrange(1 << r.choice([4, 8, 12, 16, 16])):x}" for _ in range(8)]
        return r.choice([":".join(groups), ":".join(groups[:2]) + "::" + ":".join(groups[2:4]), "fe80::" + ":".join(groups[:4]), ":".join(groups[:3]) + "::" + groups[3]])
    if kind == "CARD":
        body = r.choice("3456") + _digits(r, 14)
        if r.random() < 0.6:
            body = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        else:  # numbers that were mistyped or made up are as private
            body = r.choice("45") + body[1:] + _digits(r, 1)
        return r.choice([body, body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])
    if kind == "SSN":
        return f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    if kind == "IBAN":
        code, body = r.choice(["DE", "FR", "ES", "GB"]), _digits(r, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + code + "00")) % 97
        whole = f"{code}{check:02d}{body}"
        return r.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])
    some = lambda of, n: "".join(r.choice(of) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    mixed = lambda n: some(alnum, n - 2) + r.choice(string.digits) + r.choice(string.ascii_letters)
    value = r.choice([hexa(18), hexa(32), hexa(40), mixed(20), mixed(8), some(string.ascii_lowercase, r.randint(6, 24)), some(alnum, 5) + r.choice("!$#%") + some(alnum, 3), ".".join(some(alnum + "_-", r.randint(20, 60)) + "x" for _ in range(3))])
    key = r.choice(["password", "token", "secret", "api_key", "passwd", "access_key"])
    form = r.choice(["assigned"] * 4 + ["named"] * 3 + ["prefix", "prefix", "opaque", "pem"])
    if form == "assigned":
        return r.choice([f"{key}={value}", f'{key} = "{value}"', f"{key}: {value}", f"{key}='{value}'"])
    if form == "prefix":
        return r.choice(["AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "AKIA" + some(string.ascii_uppercase, 16), "ghp_" + some(string.ascii_letters, 36), "sk_live_" + mixed(24), "xoxb-" + _digits(r, 11) + "-" + mixed(24)])
    if form == "pem":
        kind = r.choice(["", "RSA ", "EC "])
        return f"-----BEGIN {kind}PRIVATE KEY-----" + r.choice(["", "\n" + "\n".join(some(alnum + "+/", 40) for _ in range(r.randint(1, 3))) + f"\n-----END {kind}PRIVATE KEY-----"])
    if form == "opaque":
        return mixed(r.randint(24, 60))
    return NAMED + r.choice([mixed(r.choice([10, 16, 40, 150])), _ascii(r) + _digits(r, r.randint(1, 4)) + r.choice(["", _ascii(r)]), _ascii(r) + _digits(r, 3) + _ascii(r), ".".join(some(alnum + "_-", r.randint(5, 40)) for _ in range(3)) + "x"]).rjust(6, "q")


NAMED = "\0"  # a value that one of these comes before
_CALLED = ("token ", "Bearer ", "password ", "secret is ", "the password is ", "auth ")


def _ascii(r: random.Random) -> str:
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))


def _decoy(r: random.Random) -> str:
    n = lambda a, b: str(r.randint(a, b))
    return r.choice([
        f"{n(0, 9)}.{n(0, 9)}", f"{n(0, 9)}.{n(0, 99)}.{n(0, 9)}", f"version {n(0, 9)}.{n(0, 9)}", f"{n(1900, 2099)}", f"{n(1, 31)}.{n(1, 12)}.{n(1950, 2030)}", f"{n(1950, 2030)}-{int(n(1, 12)):02d}-{int(n(1, 28)):02d}",
        f"{n(0, 23)}:{int(n(0, 59)):02d}", f"{n(1, 999)},{_digits(r, 3)}", f"${n(1, 999)}.{_digits(r, 2)}", f"{n(1, 99)}%", n(0, 99999), f"@{_ascii(r)}", f"x{n(0, 9)} = {n(0, 99)}", f"{n(1, 20)}-{n(20, 40)}",
        f"{n(1, 99)} {_ascii(r)}", f"{_ascii(r)}{n(0, 99)}", f"({n(1900, 2030)})", f"[{n(1, 30)}]", f"{n(10, 99)} {n(100, 999)} {n(100, 999)}", f"pp. {n(10, 99)}-{n(100, 999)}", f"BY-NC {n(1, 4)}.0", f"{_digits(r, 7)}", f"{n(1, 9)}/{n(1, 9)}",
        f"{n(256, 999)}.{n(256, 999)}.{n(0, 99)}.{n(0, 99)}", f"1.{n(0, 9)}.{n(0, 9)}.", f"{n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)}", f"width={n(1, 999)}", f"id: {n(1, 9999)}",
        f"{n(0, 23)}:{int(n(0, 59)):02d}:{int(n(0, 59)):02d}", f"std::{_ascii(r)}", f"the password {_word(r)}", f"a token {_word(r)} {_word(r)}", f"secret {_word(r)}", f"secret of {_word(r)}", _ascii(r) + "".join(_word(r) for _ in range(6)), f"{_ascii(r)}-{_ascii(r)}-{_ascii(r)}-{_ascii(r)}-{_ascii(r)}",
        "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), f"http://{_ascii(r)}.org/{_ascii(r)}/{_ascii(r)}-{_ascii(r)}.html", f"/{_ascii(r)}/{_ascii(r)}/{_ascii(r)}_{n(1, 99)}.txt", f"{_ascii(r)}_{_ascii(r)}_{_ascii(r)}_{_ascii(r)}_{_ascii(r)}",
    ])


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated (text, [(start, stop, kind 1..)])."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(2, 5)):
            text += " ".join(_word(r) for _ in range(r.randint(0, 4)))
            text += r.choice([" ", " ", " ", ", ", "\n", ": "]) if text else ""
            if r.random() < 0.55:
                kind = r.randrange(len(KINDS))
                s = _entity(r, KINDS[kind])
                if s[0] == NAMED:
                    s = s[1:]
                    text += r.choice(_CALLED)
                gold.append((len(text), len(text) + len(s), kind + 1))
            else:
                s = _decoy(r)
            text += s + r.choice([" ", " ", " ", ", ", ". ", ".", "\n", "! ", ""])
            if text.endswith(s):  # an end of the text
                break
        out.append((text, gold))
    return out


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis)) + safe


def fit(data: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 2, rate: float = 0.4, decay: float = 1e-4) -> SemiCrf:
    k = len(KINDS) + 1
    index: dict[str, int] = {"outside": 0}
    ready = []
    for text, gold in data:
        tokens, spans = candidates(text)
        begin, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        truth = {(begin[a], end[b]): kind for a, b, kind in gold if a in begin and b in end}
        rows = [(a, b, np.array([index.setdefault(f, len(index)) for f in features])) for a, b, features in spans]
        ready.append((len(tokens), rows, truth))
    w, moves = np.zeros((len(index), k)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-2), np.full_like(moves, 1e-2)
    for _ in range(rounds):
        for n, rows, truth in ready:
            if not rows:
                continue
            score = np.array([w[f].sum(0) for _, _, f in rows])
            score[:, 0] = -np.inf
            ends: list[list[int]] = [[] for _ in range(n + 1)]
            starts: list[list[int]] = [[] for _ in range(n + 1)]
            for i, (a, b, _) in enumerate(rows):
                ends[b].append(i)
                starts[a].append(i)
            first = np.full(k, -np.inf)
            first[0] = 0
            alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
            alpha[0], beta[n] = first, 0
            into = np.zeros((n + 1, k))  # by start of a segment and its kind
            for b in range(n + 1):
                if b:
                    parts = [np.where(np.arange(k) == 0, into[b - 1] + w[0, 0], -np.inf), *(into[rows[i][0]] + score[i] for i in ends[b])]
                    alpha[b] = _lse(np.array(parts))
                into[b] = _lse(alpha[b][:, None] + moves)
            out = np.zeros((n + 1, k))  # of a segment that starts here, by its kind
            for a in range(n - 1, -1, -1):
                parts = [np.where(np.arange(k) == 0, beta[a + 1] + w[0, 0], -np.inf), *(beta[rows[i][1]] + score[i] for i in starts[a])]
                out[a] = _lse(np.array(parts))
                beta[a] = _lse((moves + out[a][None, :]).T)
            z = _lse(alpha[n])
            dw: dict[int, np.ndarray] = {}
            for i, (a, b, f) in enumerate(rows):
                p = np.exp(into[a] + score[i] + beta[b] - z)
                if (kind := truth.get((a, b))) is not None:
                    p[kind] -= 1
                if np.abs(p).max() > 1e-6:
                    for x in f.tolist():
                        dw[x] = dw.get(x, 0) + p
            dm = sum(np.exp(alpha[a][:, None] + moves + out[a][None, :] - z) for a in range(n))
            kinds, t = [], 0
            jump = {a: (b, kind) for (a, b), kind in truth.items()}
            while t < n:
                b, kind = jump.get(t, (t + 1, 0))
                kinds.append(kind)
                t = b
            for x, y in zip([0, *kinds[:-1]], kinds, strict=True):
                dm[x, y] -= 1
            dm[0, 0] = 0  # with no weight of a token outside, an entity's length alone speaks neither for nor against it
            for x, g in dw.items():
                g = g + decay * w[x]
                gw[x] += g * g
                w[x] -= rate * g / np.sqrt(gw[x])
            dm = dm + decay * moves
            gm += dm * dm
            moves -= rate * dm / np.sqrt(gm)
    return SemiCrf({(f, kind): float(w[i, kind]) for f, i in index.items() for kind in range(k) if w[i, kind]}, moves)


@lru_cache(maxsize=4)
def model(sentences_used: int = 500, seed: int = 7) -> SemiCrf:
    """The trained model; the generated training set's size and seed are its parameters."""
    return fit(sentences(sentences_used, seed))


# --- inference ------------------------------------------------------------------------------------

_DIGIT = np.zeros(256, bool)
_DIGIT[[*range(48, 58), 64]] = True
_SOLID = ~T.WHITE
_SOLID[[28, 29, 30, 31]] = False
_LONG_BYTES = re.compile(rb"[A-Za-z0-9+/_=.~-]{%d,}" % LONG)


def windows(row: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a text around its marks, ``MAX_TOKENS`` words to either side; they don't touch."""
    at = np.flatnonzero(_DIGIT[row])
    end = at + 1
    raw = row.tobytes()
    low = T.LOWER[row].tobytes()
    first = np.flatnonzero(_SOLID[row] & np.concatenate([[True], ~_SOLID[row[:-1]]])) if len(row) else at
    last = np.flatnonzero(_SOLID[row] & np.concatenate([~_SOLID[row[1:]], [True]])) + 1 if len(row) else at
    long = len(first) and int((last - first).max()) >= LONG
    if long or any(h in low for h in _HINTS) or raw.count(b":") >= 7:
        text = raw.decode("utf-8", "replace")
        spans = marked(text)[0]
        if spans:
            a, b = np.array(spans).T
            if len(text) != len(raw):
                byte = np.flatnonzero((row & 0xC0) != 0x80)
                byte = np.concatenate([byte, [len(row)]])
                a, b = byte[a], byte[b]
            order = np.argsort(np.concatenate([at, a]), kind="stable")
            at, end = np.concatenate([at, a])[order], np.maximum.accumulate(np.concatenate([end, b])[order])
    if not len(at):
        return []
    reach = MAX_TOKENS + 1
    lo = np.maximum(np.searchsorted(first, at, "right") - 1 - reach, 0)
    hi = np.minimum(np.searchsorted(last, end, "left") + reach, len(last) - 1)
    gap = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1])
    lo, hi = lo[np.concatenate([[0], gap + 1])], np.maximum.accumulate(hi)[np.concatenate([gap, [len(hi) - 1]])]
    return list(zip(first[lo].tolist(), last[hi].tolist(), strict=True))


def entities(crf: SemiCrf, row: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, stop, kind, gain) in bytes, for one text's bytes."""
    out = []
    for lo, hi in windows(row) if crf.never_plain() else [(0, len(row))]:
        # what features see beyond a span stays in view
        a, b = max(0, lo - 1), min(len(row), hi + 2)
        while a > 0 and row[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(row) and row[b] & 0xC0 == 0x80:
            b += 1
        text = row[a:b].tobytes().decode("utf-8", "replace")
        found = crf.segments(text)
        if found:
            at = a + np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
            out += [(int(at[i]), int(at[j]), kind, gain) for i, j, kind, gain in found]
    return out


def _find(crf):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = crf.value
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(1)):
                rows, spans = [], []
                for i in range(hi - lo):
                    row = data[offsets[i] : offsets[i + 1]]
                    if found := entities(own, row):
                        start = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
                        rows += [i] * len(found)
                        spans += [(int(start[a]), int(start[b]), KINDS[kind - 1], gain) for a, b, kind, gain in found]
                if rows:
                    a, b, kind, gain = zip(*spans, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind), pa.array(gain, pa.float64())], ["doc_id", "start", "stop", "kind", "score"])

    return find


def find_private(docs: DataFrame, crf: SemiCrf | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(crf or model())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_find(shared), "doc_id long, start int, stop int, kind string, score double")


def redacted(docs: DataFrame, crf: SemiCrf | None = None) -> DataFrame:
    """The documents with each entity replaced by [KIND]; n_chars follows where it is a column, the rest stays."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or model())
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(at)
            new = {}
            for lo, hi, data, offsets in T.text_slices(column):
                for i in range(hi - lo):
                    row = data[offsets[i] : offsets[i + 1]]
                    if found := entities(own, row):
                        raw, parts, a = row.tobytes(), [], 0
                        for start, stop, kind, _ in found:
                            parts += [raw[a:start], f"[{KINDS[kind - 1]}]".encode()]
                            a = stop
                        new[lo + i] = b"".join([*parts, raw[a:]]).decode()
            if not new:
                yield batch
                continue
            mask = np.zeros(len(column), bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))
            columns = list(batch.columns)
            columns[at] = texts
            if count is not None:
                columns[count] = pc.if_else(pa.array(mask), pc.cast(pc.utf8_length(texts), columns[count].type), columns[count])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
