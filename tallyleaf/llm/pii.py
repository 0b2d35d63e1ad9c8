"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
schemes, digits, plus signs and identifier cues.  Each anchor is handed to a
small deterministic parser which expands it to the left and right and
validates what it finds.  Base kinds (email, ip, card, phone) equal the
leftmost non-overlapping matches of their patterns; the further kinds (url,
account, secret, address) come from schemes and cues.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tallyleaf.llm.common import map_texts

BASE = ("email", "ip", "card", "phone")
MORE = ("url", "account", "secret", "address")

# Cues that announce an identifier, a secret or a street.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "passport", "ssn", "tax id", "customer no")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api key")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "straße", "strasse", "rue", "calle", "avenida")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
URL_REST = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT_VALUE = re.compile(r"(?:\s(?:number|no|nr))?\.?\s?[:=#]?\s?[\"']?((?=[A-Z0-9 -]*[0-9])[A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
SECRET_VALUE = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_+/=.-]{8,})")
HOUSE_BEFORE = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]?,?\x20(?:[^\W\d_]+\x20){0,3}\Z")
HOUSE_AFTER = re.compile(r"(?:\x20[^\W\d_]+){0,4},?\x20[0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z])")
REACH = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    for word, kind in (("@", "@"), ("+", "+"), ("://", "s")):
        a.add_word(word, (kind, len(word)))
    for kind, cues in (("a", ACCOUNT_CUES), ("k", SECRET_CUES), ("r", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def emails(text: str, at: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for p in at:
        s = p
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < p and (m := DOMAIN.match(text, p + 1)):
            done = m.end()
            yield s, done


def runs_of(digits: list[int]) -> list[tuple[int, int]]:
    runs, start, last = [], digits[0], digits[0]
    for p in digits[1:]:
        if p != last + 1:
            runs.append((start, last + 1))
            start = p
        last = p
    runs.append((start, last + 1))
    return runs


def chains(text: str, runs: list[tuple[int, int]], glue: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of digits with exactly one character of ``glue`` between neighbours."""
    chain = [runs[0]]
    for run in runs[1:]:
        if run[0] == chain[-1][1] + 1 and text[chain[-1][1]] in glue:
            chain.append(run)
        else:
            yield chain
            chain = [run]
    yield chain


def ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            four = chain[k : k + 4]
            if all(len(part := text[s:e].lstrip("0")) <= 3 and int(part or 0) <= 255 for s, e in four):
                yield four[0][0], four[3][1]


def cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in chains(text, runs, " -"):
        if 13 <= sum(e - s for s, e in chain) <= 19 and luhn("".join(text[s:e] for s, e in chain)):
            yield chain[0][0], chain[-1][1]


def phones(text: str, plus: list[int]) -> Iterator[tuple[int, int]]:
    for p in plus:
        if (m := PHONE.match(text, p)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def urls(text: str, schemes: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for p in schemes:
        m = SCHEME.search(text[max(done, p - 20) : p])
        rest = URL_REST.match(text, p + 3)
        if m and rest:
            end = p + 3 + len(rest[0].rstrip(".,;:!?'\")]"))
            start = p - len(m[0])
            if end > p + 3:
                done = rest.end()
                yield start, end


def after_cue(text: str, cues: list[tuple[int, int]], value: re.Pattern) -> Iterator[tuple[int, int]]:
    done = 0
    for s, e in cues:
        if s >= done and not (s and text[s - 1].isalpha()) and (m := value.match(text, e)):
            done = m.end(1)
            yield m.span(1)


def streets(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    done = 0
    for s, e in cues:
        if s < done or (e < len(text) and text[e].isalpha()):
            continue
        lo = max(done, s - REACH)
        if m := HOUSE_BEFORE.search(text[lo:s]):
            done = e
            yield lo + m.start(), e
        elif not (s and text[s - 1].isalpha()) and (m := HOUSE_AFTER.match(text, e, e + REACH)):
            done = m.end()
            yield s, done


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of every kind that occurs."""
    hits: dict[str, list] = {}
    for last, (kind, n) in anchors.iter(text):
        hits.setdefault(kind, []).append(last if n == 1 else (last - n + 1, last + 1))
    found: dict[str, list[tuple[int, int]]] = {}
    if "@" in hits:
        found["email"] = list(emails(text, hits["@"]))
    if "d" in hits:
        runs = runs_of(hits["d"])
        found["ip"], found["card"] = list(ips(text, runs)), list(cards(text, runs))
        found["phone"] = list(phones(text, hits.get("+", [])))
        found["account"] = list(after_cue(text, hits.get("a", []), ACCOUNT_VALUE))
        found["address"] = list(streets(text, hits.get("r", [])))
    if "s" in hits:
        found["url"] = list(urls(text, [s for s, _ in hits["s"]]))
    if "k" in hits:
        found["secret"] = list(after_cue(text, hits["k"], SECRET_VALUE))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in sorted(found.get(k, ())))


def scan():
    anchors = automaton()

    def rows(texts: list[str]):
        for text in texts:
            found = find(text, anchors)
            base = joined(found, BASE)
            yield (
                *(len(found.get(k, ())) for k in BASE),
                hashlib.sha256(base.encode()).hexdigest(),
                joined(found, BASE + MORE),
                sum(len(found.get(k, ())) for k in MORE),
            )

    return rows


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans.

    Null and empty texts have no spans (digest of the empty string).  Texts
    are scanned whole; time is linear in their length.
    """
    return map_texts(docs, scan, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")


def redact(text: str, anchors=None) -> str:
    """The text with every span replaced by its kind in brackets (first span wins on overlap)."""
    found = find(text or "", anchors or automaton())
    spans = sorted((s, -e, k) for k, v in found.items() for s, e in v)
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"[{kind}]"]
            done = -e
    return "".join(out) + (text or "")[done:]
