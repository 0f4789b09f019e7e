"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow the contract's patterns and always stay; nothing is learned
about them. Candidates of four added kinds come from looser patterns: secrets (long mixed runs, and
values assigned to a password, token or key, however short), written-out addresses, telephone numbers
without a plus, account and social security numbers. Five labelers vote on every candidate - regex
shape, gazetteer, words before, validity, surroundings - or abstain. Votes are counted over all
documents by pattern (a bounded table: kinds x 3**5 votes x a few length and digit classes).

Expectation-maximisation estimates, for each kind, the reliability of every labeler and the probability
of each pattern. It is anchored by :func:`made_examples`, a fixed set of ``EXAMPLES`` labelled snippets
for each kind, half of them personal data, half look-alikes (hashes, identifiers, paths, versions, ISBNs,
counts). For each kind the corpus's patterns together weigh as much as the examples, whatever the size of the
corpus, so a corpus in which every candidate is personal data can't teach the model to accept everything.
A logistic span classifier is trained on the examples' labels and the corpus's probabilities. Candidates
that it accepts are added to the base spans.

Defined results: a null text counts as empty and stays null when masked; positions are code points,
ends exclusive; very long texts are read whole in linear time; repeated rows are treated each; an
empty table gives no rows; extra columns are ignored, or passed on by :func:`mask`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans of one start are listed.
KINDS = (*BASE, "secret", "address", "number", "account")
_ORDER = {k: i for i, k in enumerate(KINDS)}
ADDED = KINDS[len(BASE) :]
#: Labelled snippets of each added kind that anchor the model, half of them personal data.
EXAMPLES = 800

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63} ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|auth|private)[_ -]?key)[\"']?[ \t]{0,4}(?::=|=>|=|:)[ \t]{0,4}[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE)
_ASSIGNS = ("passw", "passphrase", "pwd", "secret", "token", "key")
_PROVIDER = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}.*|sk-[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{16,}", re.DOTALL)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile(r"[A-Za-z0-9]+")
_BEFORE = re.compile(r"[A-Za-z_]+[0-9]*")

#: Gazetteers.
_TLDS = frozenset("com org net edu gov mil int info biz name io de fr es it uk us ca eu ch at nl be se no dk fi pl pt ru cn jp in br au example test".split())
_IBAN = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
#: Words before a value that speak for it, and some that speak against it.
_FOR = {
    "secret": frozenset("token secret key apikey api password passwd passphrase pwd bearer auth authorization credential credentials access".split()),
    "address": frozenset("mail email e contact write at".split()),
    "number": frozenset("phone tel telephone call mobile cell fax whatsapp".split()),
    "account": frozenset("ssn social security iban account konto".split()),
}
_AGAINST = frozenset("version v isbn issn doi sku commit sha sha1 sha256 sha512 md5 crc32 checksum hash digest etag base64 build revision rev id uuid guid serial part model item order invoice section chapter page figure table row rows lot batch ref reference case ticket issue tracking number_of".split())

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base kinds, leftmost and without overlap within a kind, failing matches dropped; linear in the text."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        after = at + 1
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                last = after = m.end()
        at = text.find("@", after)
    if first := _DIGIT.search(text):
        begin = first.start()
        for m in _DOTTED.finditer(text, begin):
            if m[0].count(".") >= 3:
                start, parts = m.start(), m[0].split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                        out.append((start, start + size, "ip"))
                    start += size + 1
        for m in _CARD.finditer(text, begin):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if (plus := text.find("+")) >= 0:
            for m in _PHONE.finditer(text, plus):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Further candidates, none of which touches a base span or an earlier candidate."""
    out: list[Span] = []
    taken = sorted((s, e) for s, e, _ in base)
    patterns = []
    if "at]" in text or "at)" in text:
        patterns.append(("address", _ADDRESS))
    low = text.lower()
    if any(x in low for x in _ASSIGNS):
        patterns.append(("secret", _ASSIGNED))
    if _DIGIT.search(text):
        patterns += [("account", _ACCOUNT), ("secret", _SECRET), ("number", _NUMBER)]
    for kind, pattern in patterns:
        new = []
        for m in pattern.finditer(text):
            start, end = m.span(1) if pattern is _ASSIGNED else m.span()
            if pattern is _ASSIGNED:
                if text[end : end + 1] not in ('"', "'"):  # else the quotes say where it ends
                    end = start + len(text[start:end].rstrip(".)]}!?"))
                if end - start < 6:
                    continue
            elif kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            elif kind == "account" and m[0][0].isalpha() and " " not in m[0] and not _iban(m[0]):
                continue  # a long run, to be judged as a secret
            new.append((start, end, kind))
        starts = [t[0] for t in taken]
        for s, e, k in new:
            i = int(np.searchsorted(starts, e)) if starts else 0
            if i == 0 or max(t[1] for t in taken[max(0, i - 8) : i]) <= s:
                out.append((s, e, k))
        taken = sorted([*taken, *((s, e) for s, e, _ in out)])
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _iban(value: str) -> bool:
    """Whether the check digits hold (a remainder of 1 by 97)."""
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _wordy(value: str) -> bool:
    """Whether it reads as words or path parts with separators: most letters stand in lower-case runs of three or more."""
    runs = _WORDS.findall(re.sub(r"[_+/.=-]", " ", value))
    plain = sum(len(r) for r in runs if r.isalpha() and (r.islower() or r.istitle()) and 2 <= len(r) <= 14)
    return 2 * plain >= sum(map(len, runs)) and (len(runs) > 1 or bool(runs) and runs[0].isalpha())


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Of shape, gazetteer, words before, validity and surroundings on a candidate of an added kind: 1 for, 0 against, 2 abstains."""
    start, end, kind = span
    value = text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    before = [w.lower() for w in _BEFORE.findall(text[max(0, start - 40) : start])[-4:]]
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = gazetteer = valid = 2
    edge = 0 if left in ("/", "#", "-", "_", "+") and left or right in ("/", "-", "_") and right else 2
    if kind == "address":
        host = re.split(r"\[at\]|\(at\)", value.lower())[-1]
        shape = 1 if "[" in value or "dot)" in value else 2
        gazetteer = int(re.split(r"\.|\]|\)| ", host)[-1] in _TLDS)
        valid = int(". " not in host and any(c.isalpha() for c in re.split(r"\[at\]|\(at\)", value)[0]))
    elif kind == "number":
        area, exchange = digits[:3], digits[3:6]
        shape = 1 if "(" in value or value.count("-") == 2 else 0 if value.count(" ") == 2 else 2
        gazetteer = int(area[0] not in "01" and exchange[0] not in "01")
        valid = int(not area.endswith(("00", "11")) and not digits.endswith("000") and len(set(digits)) > 2)
    elif kind == "account":
        if value[0].isalpha():
            shape = 1 if value.count(" ") or len(value) > 18 else 2
            gazetteer = int(value[:2] in _IBAN)
            valid = int(_iban(value))
        else:
            shape = 1
            gazetteer = int(digits[0] != "9" and not digits.startswith(("000", "666")))
            valid = int(digits[3:5] != "00" and digits[5:] != "0000" and len(set(digits)) > 2)
    else:
        body = value.rstrip("=")
        classes = sum((any(c.islower() for c in body), any(c.isupper() for c in body), any(c.isdigit() for c in body), any(not c.isalnum() for c in body)))
        given = text[max(0, start - 8) : start]
        assigned = bool(re.search(r"[=:]>?[ \t]{0,4}[\"']?$", given))
        literal = bool(re.search(r"[=:]>?[ \t]{0,4}[\"']$|[A-Za-z_]=$", given))  # in quotes, or right after an equals sign
        gazetteer = 1 if _PROVIDER.fullmatch(body) else 0 if _UUID.fullmatch(body) or re.search(r"[(){}$\[\]]|::|\.\w+\(", body) else 2
        shape = 0 if _wordy(body) or body.count("/") > 1 and "." not in body and not assigned else 1 if classes >= 3 else 2
        valid = int(_entropy(body) >= (3.0 if len(body) >= 16 else 2.2) and classes > 1)
        edge = 1 if literal else 2 if assigned or left and left in "\"'" else edge
    near = _FOR[kind]
    context = 0 if any(w.strip("_") in _AGAINST for w in before[-2:]) else 1 if any(w in near or any(x in near for x in w.split("_")) for w in before) else 2
    if kind != "secret" and edge and left in ("", " ", "\n", "\t", '"', "'", "(", ":", "<", "=") and (not right or right in " \n\t\"').,;:>!?"):
        edge = 1
    return (shape, gazetteer, context, valid, edge)


def pattern_of(text: str, span: Span) -> str:
    """The span's discrete features: kind, votes, class of length, class of the share of digits."""
    start, end, kind = span
    value = text[start:end]
    digits = sum("0" <= c <= "9" for c in value)
    return f"{kind}|{''.join(map(str, votes(text, span)))}|{min((end - start) // 8, 5)}|{digits * 3 // (end - start)}"


_UPPER, _LOWER, _DIGITS, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_PLAIN = "module table value server page north report winter index data green path user house lines query music stone river paper config build shared notes".split()


def _example(rnd: random.Random, kind: str, personal: bool) -> tuple[str, str]:
    """A snippet and the value in it."""
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    word = lambda: rnd.choice(_PLAIN)
    mixed = lambda n: run(_UPPER, 1) + run(_LOWER, 1) + run(_DIGITS, 1) + run(_UPPER + _LOWER + _DIGITS, n - 3)
    if kind == "secret" and personal:
        value = rnd.choice([lambda: run(_HEX, rnd.choice([32, 40, 64])) + "a1", lambda: mixed(rnd.randint(20, 48)), lambda: "AKIA" + run(_UPPER + _DIGITS, 15) + "7", lambda: "ghp_" + mixed(36), lambda: f"sk_live_{mixed(24)}", lambda: run(_LOWER, rnd.randint(4, 7)) + run(_DIGITS, rnd.randint(2, 4)) + rnd.choice(["", "!", "#"]), lambda: mixed(rnd.randint(8, 14))])()
        if rnd.random() < 0.12:
            plain = run(_LOWER, rnd.randint(7, 12))
            return rnd.choice([f'password = "{plain}"', f"{word()} pwd='{plain}' {word()}", f'"password": "{plain.title()}"', f"passwd: '{plain}!'"]), plain
        name = rnd.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "pwd", "client_secret", "API_KEY"])
        forms = [f'{word()} {name} = "{value}" {word()}', f"{word()} {name}: {value} {word()}", f"{name}={value}", f'"{name}": "{value}",']
        if _PROVIDER.fullmatch(value):
            forms += [f"{word()} {value} {word()}"] * 4
        return rnd.choice(forms), value
    if kind == "secret":
        hashed = run(_HEX, rnd.choice([32, 40, 64])) + "b2"
        uuid = "-".join(run(_HEX, n) for n in (8, 4, 4, 4, 11)) + "4"
        path = "/".join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(["3", "2", "64"]) + "/" + word()
        slug = "-".join([word() for _ in range(rnd.randint(4, 7))] + [run(_DIGITS, rnd.choice([1, 2, 4])), word()])
        name = "_".join([word() for _ in range(rnd.randint(4, 6))]) + "_" + run(_DIGITS, 2)
        label = rnd.choice(["commit", "sha256:", "sha1", "md5", "checksum", "digest", "etag:", "hash =", "revision", "base64,"])
        forms = [(f"{word()} {label} {hashed} {word()}", hashed), (f'"{label.strip(" :=,")}": "{hashed}"', hashed), (f"{word()} {hashed} {word()}", hashed), (f"id {uuid}", uuid), (f"{word()} {uuid} {word()}", uuid), (f"uuid: {uuid}", uuid)]
        forms += [(f"{word()} /{path}", path), (f"{word()} {slug} {word()}", slug), (f"{word()} {name} {word()}", name), (f"https://site.example/{slug}", slug)]
        plain = "".join(_LOWER[ord(c) % 26] for c in run(_LOWER, rnd.randint(6, 10)))
        forms += [(f"{rnd.choice(['the secret', 'a token', 'password', 'token'])}: {plain} {word()}", plain), (f"token = {plain}({word()})", plain + "(" + word())]
        text, value = rnd.choice(forms)
        return text, value
    if kind == "number":
        area, exchange, last = f"{rnd.randint(2, 9)}{rnd.randint(0, 9)}{rnd.randint(2, 9)}", f"{rnd.randint(2, 9)}{run(_DIGITS, 2)}", f"{run(_DIGITS, 3)}{rnd.randint(1, 9)}"
        if personal:
            value = rnd.choice([f"({area}) {exchange}-{last}", f"{area}-{exchange}-{last}"])
            if rnd.random() < 0.3:
                value = f"{area}{(sep := rnd.choice('. '))}{exchange}{sep}{last}"
                return f"{rnd.choice(['call', 'phone:', 'tel', 'fax', 'mobile'])} {value} {word()}", value
            return rnd.choice([f"{word()} {value}", f"call {value}.", f"phone: {value},", f"{word()} {word()} {value} {word()}"]), value
        value = rnd.choice([f"{rnd.choice('01')}{run(_DIGITS, 2)}-{run(_DIGITS, 3)}-{run(_DIGITS, 4)}", f"{area} {exchange} {last}", f"{rnd.randint(2, 9)}00 {rnd.randint(2, 9)}00 {rnd.randint(1, 9)}000", f"{area}-{exchange}-{last}", f"{area}.{exchange}.{last}"])
        if value.count("-") == 2 and value[0] not in "01" or rnd.random() < 0.5:
            return f"{rnd.choice(['ISBN', 'SKU', 'part', 'version', 'order', 'serial', 'model', 'invoice', 'doi', 'item'])} {value} {word()}", value
        return f"{word()} {value} {word()}", value
    if kind == "account":
        if personal:
            if rnd.random() < 0.5:
                value = f"{rnd.randint(101, 665)}-{rnd.randint(10, 99)}-{run(_DIGITS, 3)}{rnd.randint(1, 9)}"
                return rnd.choice([f"SSN {value}", f"social security number {value} {word()}", f"{word()} {value} {word()}", f"ssn: {value}"]), value
            body = run(_DIGITS, rnd.choice([12, 16, 18]))
            country = rnd.choice(sorted(_IBAN))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            value = f"{country}{check:02d}{body}"
            if rnd.random() < 0.5:
                value = " ".join(value[i : i + 4] for i in range(0, len(value), 4))
            return rnd.choice([f"IBAN {value}", f"account: {value}", f"{word()} {value} {word()}"]), value
        value = rnd.choice([f"{rnd.choice(['000', '666', '9' + run(_DIGITS, 2)])}-{run(_DIGITS, 2)}-{run(_DIGITS, 4)}", f"{run(_DIGITS, 3)}-{run(_DIGITS, 2)}-{run(_DIGITS, 4)}", f"{run('QXZWUV', 2)}{run(_DIGITS, 2)} {run(_UPPER + _DIGITS, 4)} {run(_DIGITS, 4)} {run(_UPPER, 4)}", f"{run('QXZWUV', 2)}{run(_DIGITS, 2)}{run(_DIGITS, 12)}", f"{rnd.choice(sorted(_IBAN))}00{run(_DIGITS, 16)}"])
        if value[0].isdigit() and value[:3] not in ("000", "666") and value[0] != "9" or rnd.random() < 0.5:
            return f"{rnd.choice(['part', 'SKU', 'serial', 'model', 'ISBN', 'ref', 'order', 'batch', 'item'])} {value} {word()}", value
        return f"{word()} {value} {word()}", value
    at, dot = rnd.choice(["[at]", "(at)", " [at] ", " (at) "]), rnd.choice([".", " [dot] ", "[dot]", " (dot) "])
    if personal:
        value = f"{word()}{rnd.choice(['', '.', '_'])}{word()}{rnd.choice(['', '7'])}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'edu', 'io'])}"
        return rnd.choice([f"mail {value}", f"contact: {value},", f"{word()} {value} {word()}", f"write to {value}."]), value
    value = f"{word()} (at) {word()}. {rnd.choice(['Then', 'After', 'The', 'And', 'when', 'these'])}"
    return f"{word()} {value} {word()}", value


def made_examples(n: int = EXAMPLES, seed: int = 1) -> dict[str, list[int]]:
    """pattern -> [look-alikes, personal data], from ``n`` made snippets of each added kind, half and half."""
    rnd, out = random.Random(seed), {}
    for kind in ADDED:
        for k in range(n):
            text, value = _example(rnd, kind, personal=k % 2 == 0)
            for s, e, found in loose_spans(text, []):
                if found == kind and (text[s:e].lower() in value.lower() or value.lower() in text[s:e].lower()):
                    out.setdefault(pattern_of(text, (s, e, kind)), [0, 0])[1 - k % 2] += 1
    return out


_START = np.array([[0.55, 0.1, 0.35], [0.1, 0.55, 0.35]])


def _weighed(counts: dict[str, int], examples: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, kinds, weights of the corpus, weights of the examples by class): for each kind the corpus weighs as much as its examples."""
    names = sorted({p for p in {*counts, *examples} if p.split("|")[0] in ADDED})
    kind = np.array([ADDED.index(p.split("|")[0]) for p in names], dtype=np.int64)
    own, made = np.array([counts.get(p, 0) for p in names], dtype=float), np.array([examples.get(p, [0, 0]) for p in names], dtype=float).reshape(-1, 2)
    total = np.bincount(kind, made.sum(axis=1), len(ADDED)) / np.maximum(np.bincount(kind, own, len(ADDED)), 1e-9)
    return names, kind, own * np.where(total > 0, total, 1.0)[kind] if len(names) else own, made


def reliabilities(counts: dict[str, int], examples: dict[str, list[int]] | None = None, rounds: int = 60) -> tuple[np.ndarray, dict[str, float]]:
    """(P(vote | class) as [kind, labeler, class, vote], pattern -> probability of personal data), by EM over counted patterns.

    The examples' labels are given; the corpus's are estimated.
    """
    names, kind, own, made = _weighed(counts, made_examples() if examples is None else examples)
    v = np.array([[int(c) for c in p.split("|")[1]] for p in names], dtype=np.int64).reshape(len(names), 5)
    table_ = np.tile(_START, (len(ADDED), 5, 1, 1))
    prior = np.full(len(ADDED), 0.5)
    post = np.zeros(len(names))
    for _ in range(rounds if names else 0):
        score = np.log(np.stack([1 - prior[kind], prior[kind]]))
        for j in range(v.shape[1]):
            score += np.log(table_[kind, j][np.arange(len(names)), :, v[:, j]]).T
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        by_class = np.stack([own * (1 - post) + made[:, 0], own * post + made[:, 1]])
        for k in range(len(ADDED)):
            at = kind == k
            for j in range(v.shape[1]):
                for y in (0, 1):
                    seen = np.bincount(v[at, j], weights=by_class[y, at], minlength=3) + 2 * _START[y]
                    table_[k, j, y] = seen / seen.sum()
            prior[k] = (by_class[1, at].sum() + 1) / (by_class[:, at].sum() + 2)
    return table_, dict(zip(names, post.tolist()))


def _design(names: list[str]) -> np.ndarray:
    """For each kind: 1, and one-hot votes, length and digit classes."""
    wide = 1 + 15 + 6 + 4
    x = np.zeros((len(names), len(ADDED) * wide))
    for i, p in enumerate(names):
        kind, vote, size, digits = p.split("|")
        at = ADDED.index(kind) * wide
        x[i, at] = 1
        for j, c in enumerate(vote):
            x[i, at + 1 + 3 * j + int(c)] = 1
        # Length and digits decide close cases only.
        x[i, at + 16 + int(size)] = x[i, at + 22 + int(digits)] = 0.3
    return x


class SpanClassifier:
    """Logistic regression over a span's discrete features; trained on labels of the examples and EM probabilities of the corpus."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, bool] = {}

    @classmethod
    def train(cls, counts: dict[str, int], ridge: float = 1.0, rounds: int = 25) -> SpanClassifier:
        examples = made_examples()
        _, post = reliabilities(counts, examples)
        names, _, own, made = _weighed(counts, examples)
        p = np.array([post[x] for x in names])
        n = own + made.sum(axis=1)
        y = (own * p + made[:, 1]) / np.maximum(n, 1e-9)
        x = _design(names)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - q)) - ridge * w)
        return cls(w)

    def accepts(self, pattern: str) -> bool:
        if pattern not in self.known:
            self.known[pattern] = bool((_design([pattern]) @ self.weights)[0] > 0)
        return self.known[pattern]


_CANDIDATES = "doc_id long, base array<struct<start:int,end:int,kind:string>>, loose array<struct<start:int,end:int,kind:string,pattern:string>>"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base spans and further candidates of every row, with their discrete features."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    loose = pa.struct([*span, pa.field("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], []]
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                more = loose_spans(t, base)
                columns[0].append([{"start": s, "end": e, "kind": k} for s, e, k in base])
                columns[1].append([{"start": s, "end": e, "kind": k, "pattern": pattern_of(t, (s, e, k))} for s, e, k in more])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(columns[0], pa.list_(span)), pa.array(columns[1], pa.list_(loose))], ["doc_id", "base", "loose"])

    return docs.select("doc_id", text_or_empty(text)).mapInArrow(run, _CANDIDATES)


def train(found: DataFrame) -> SpanClassifier:
    """From the pattern counts of all candidates. The counts are a bounded table, whatever the corpus."""
    patterns = found.select(F.explode("loose.pattern").alias("p"))
    return SpanClassifier.train({r.p: r.n for r in patterns.groupBy("p").agg(F.count("*").alias("n")).collect()})


def spans(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, loose in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                have = Counter(s["kind"] for s in base)
                for column, kind in zip(out, BASE):
                    column.append(have[kind])
                line = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
                out[4].append(hashlib.sha256(line.encode()).hexdigest())
                both = sorted([*base, *(s for s in loose if model.accepts(s["pattern"]))], key=lambda s: (s["start"], _ORDER[s["kind"]]))
                out[5].append(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in both))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def find(docs: DataFrame) -> DataFrame:
    """The spans of every row. The text is read once; the candidates are a small table in the shared folder."""
    found = settle(candidates(docs), "candidates")
    return spans(found, train(found))


def masked(text: str, model: SpanClassifier) -> str:
    """``text`` with every span, overlapping ones together, replaced by its first kind in brackets."""
    base = base_spans(text)
    both = sorted([*base, *(s for s in loose_spans(text, base) if model.accepts(pattern_of(text, s)))], key=lambda s: (s[0], _ORDER[s[2]]))
    out, at = [], 0
    for s, e, kind in both:
        if s >= at:
            out.append(text[at:s])
            out.append(f"[{kind.upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]]) if both else text


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars`` to match."""
    model = train(settle(candidates(docs).select("loose"), "candidates"))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and masked(t, model) for t in b.column(where).to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], [f.name for f in b.schema])

    casts = {"text": "string", "n_chars": "long"}
    typed = docs.select(*(F.col(f"`{c}`").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in docs.columns))
    return typed.mapInArrow(run, typed.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": (op7, None)}
