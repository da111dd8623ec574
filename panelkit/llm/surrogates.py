"""Personal data replaced by surrogates of the same kind.

Entities are found by patterns, each with a normal form (lower-case mail address, digits of
a number, and so on). The surrogate of a normal form is drawn from a keyed hash: letters
become letters of the same script and case, digits digits, names names of the same gender
and script; the layout of each mention (separators, case, a valid check digit) is kept. The
same entity gets the same surrogate everywhere, whatever text or layout it is in.

Collisions are checked over the whole corpus: of entities of one type with the same
surrogate the least keeps it, and a surrogate that is itself an entity of the corpus is
given up; the others draw again with the next attempt number, until all differ. Since a
surrogate is a function of entity and attempt, only entities past their first attempt have
to be looked up, and their table is small; if it is not, it is joined by text.

Defined results: a null text stays null, an empty one empty; texts without entities are
unchanged; repeated rows get the same text; an empty table gives an empty table; all
columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

# Forms of address and the gender they give.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
              {"m": ["n", "r", "s", "ld"], "f": ["a", "ia", "ela", "ina"], "n": ["el", "en", "is", "ar"]}),
    "cyrillic": ("ба ве га де жа за ка ле ма не по ра се та фе".split(), {"m": ["н", "р", "й"], "f": ["а", "ия", "на"], "n": ["ко", "их", "ук"]}),
    "greek": ("βα γε δι ζο θα κε λι μα νε πο ρα σε τι φα".split(), {"m": ["ος", "ης", "ας"], "f": ["α", "η", "ια"], "n": ["ου", "ις", "ω"]}),
}
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_CAPITAL = "[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"
# An apostrophe joins two parts of a name, but for a possessive s.
_NAME = _CAPITAL + r"[^\W\d_]*(?:['’](?!S\b)" + _CAPITAL + r"[^\W\d_]*)?"
_SEP = r"[^\w+(]{0,6}"
# Keys by their prefix, or long runs of letters of both cases and digits.
_PREFIX = r"(?:AKIA|ASIA|AIza|(?:sk|pk|rk)[-_](?:live_|test_|proj-|ant-)?|gh[opsur]_|github_pat_|glpat-|xox[abprs]-)"
_KEY = (r"(?<![\w+/=.-])(?:" + _PREFIX + r"[A-Za-z0-9_-]{16,}|(?=[A-Za-z0-9+/_-]*\d)(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])"
        r"[A-Za-z0-9+/_-]{24,}={0,2})(?![\w+/=-])")
_ASSIGNED = r"(?<![A-Za-z])(?P<word>(?i:(?:api)?key|token|secret|password|passwd|pwd))[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
# One look ahead and one run without a way back, so that time is linear.
_IP6 = r"(?=[0-9A-Fa-f:]*?(?:::|(?::[0-9A-Fa-f]{1,4}){7}))[0-9A-Fa-f:]*+"
PATTERN = re.compile("|".join((
    r"(?P<secret>(?<![0-9A-Za-z])(?=[0-9A-Za-z]*\d)(?=[0-9A-Za-z]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))",
    r"(?P<mail>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)",
    r"(?P<key>" + _KEY + r")",
    r"(?P<assigned>" + _ASSIGNED + r"(?![0-9A-Fa-f]{32,}(?![0-9A-Za-z]))(?=[^\s\"'<>,;]{8}))",
    r"(?P<ip6>(?<![\w:.])" + _IP6 + r"(?![\w:]|\.\d))",
    r"(?P<phone>(?<![\w+])(?:\+1" + _SEP + r"\(?\d{3}\)?" + _SEP + r"\d{3}[ .-]?\d{4}|\+\d(?:[ ().\-/]{0,3}\d){7,14}"
    r"|\+\d{1,3}" + _SEP + r"\(?\d{2,4}\)?" + _SEP + r"\d{3}[ .-]?\d{3,4})(?!\d))",
    r"(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d))",
    r"(?P<account>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<number>(?<![\d.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{3}-\d{2}-\d{4})(?!\d))",
    r"(?P<national>(?<![\w+.-])(?:(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|(?!\d\d[./-]\d\d[./-](?:\d{4}|\d\d(?![./ -]?\d)))(?:\(0\d{1,4}\)|0\d{1,4})(?:[ /.-]{1,3}\d{2,8}){1,6})(?!\w|[.-]\d))",
    r"(?P<name>(?<!\w)(?P<title>" + _TITLE + r")\.? (?P<who>" + _NAME + r"(?:[ -](?!(?:" + _TITLE + r")\b)" + _NAME + r"){0,2}))",
)))
_MAYBE = re.compile(r"@|\d[^A-Za-z]{5,}\d|[0-9A-Za-z+/_-]{19}|(?:" + "|".join(TITLES) + r")\.? [^\W\d_]").search
_MAYBE_COLON = re.compile("::|" + _ASSIGNED + r"|(?::[0-9A-Fa-f]{1,4}){7}").search
ENTITIES_SENT = 50_000
LEAST_ENTROPY = 3.5  # bits a character of a key without a known prefix
# Country codes of two digits; 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Ahead:
    """The next place of a pattern in a text, for places asked in order: one pass in all."""

    def __init__(self, text: str, pattern: str):
        self.text, self.search, self.at = text, re.compile(pattern).search, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            m = self.search(self.text, start)
            self.at = m.start() if m else len(self.text)
        return self.at


def _found(text: str) -> Iterator[tuple[re.Match, int]]:
    """Matches of the patterns, each with its end. A value assigned to a key has a digit, a
    letter, and no @ before the next space or quote; this is looked up here, since a pattern
    would read the rest of the text again at each key."""
    ends, quote, digit, letter, at_sign = (Ahead(text, p) for p in (r"[\s\"'<>,;]", r"[\s\"']", r"\d", r"[A-Za-z]", "@"))
    start = 0
    while m := PATTERN.search(text, start):
        start = end = m.end()
        if m.lastgroup == "assigned":
            end = ends(start)
            if digit(m.end()) >= end or letter(m.end()) >= end or at_sign(m.end()) < quote(m.end()):
                # Nothing starts inside the word that announces a value.
                start = m.end("word")
                continue
            start = end
        elif m.end() == m.start():
            start += 1
        yield m, end


def MAYBE(text: str) -> bool:
    """Whether a text can hold an entity: true for each that does, and quick."""
    return bool(_MAYBE(text) or (":" in text or "=" in text) and _MAYBE_COLON(text))


def country(digits: str) -> str:
    """The country code at the start of an international number."""
    if digits[0] in "17":
        return digits[0]
    two = digits[:2] in _TWO
    return digits[:2 if two else 3]


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def luhn(digits: str) -> int:
    """The sum whose remainder by 10 is 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total


def remainder(account: str) -> int:
    """By 97, of an account number with its country behind; 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity; names give one for each word."""
    if not text or not MAYBE(text):
        return
    for m, stop in _found(text):
        kind, found = m.lastgroup, m[0]
        if m["who"] is not None:
            at, words = m.start("who"), list(re.finditer(r"[^\W\d_]+", m["who"]))
            gender = TITLES[m["title"]]
            for i, w in enumerate(words):
                role = f"first:{gender}" if i + 1 < len(words) else "last"
                yield at + w.start(), at + w.end(), f"{role}:{script(w[0])}", w[0].casefold()
            continue
        if kind == "mail":
            end = m.end() - (len(found) - len(found.rstrip(".-")))
            yield m.start(), end, "mail", text[m.start():end].casefold()
        elif kind == "secret":
            yield m.start(), m.end(), "secret", found.casefold()
        elif kind == "key":
            if re.match(_PREFIX, found) or entropy(found) >= LEAST_ENTROPY:
                yield m.start(), m.end(), "key", found
        elif kind == "assigned":
            value = text[m.end():stop].rstrip(".)]}#$")
            yield m.end(), m.end() + len(value), "key", value
        elif kind == "ip6":
            end = m.end() - (found.endswith(":") and not found.endswith("::"))
            try:
                yield m.start(), end, "ip6", str(ipaddress.IPv6Address(text[m.start():end]))
            except ValueError:
                continue
        elif kind == "national":
            digits = "".join(c for c in found if c.isdigit())
            if digits.startswith("00") and 10 <= len(digits) <= 17:
                yield m.start(), m.end(), "phone", country(digits[2:]) + ":" + digits[2:]
            elif digits.startswith("0") and not re.fullmatch(r"\D*\d{3}\D+\d{3}\D\d{4}", found):
                if 9 <= len(digits) <= 12:
                    yield m.start(), m.end(), "phone", "0:" + digits
            elif len(digits) in (10, 11):
                yield m.start(), m.end(), "phone", "1:1" + digits[-10:]
        elif kind == "ip":
            yield m.start(), m.end(), "ip", ".".join(str(int(x)) for x in found.split("."))
        elif kind == "account":
            yield m.start(), m.end(), "account", found.replace(" ", "")
        else:
            digits = "".join(c for c in found if c.isdigit())
            valid = kind == "number" and len(digits) > 12 and luhn(digits) % 10 == 0
            if kind == "phone":
                # The country code stays.
                digits = country(digits) + ":" + digits
            yield m.start(), m.end(), "number:valid" if valid else kind, digits


class Stream:
    """Numbers from a keyed hash of type, entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.block, self.left = hashlib.blake2b("\0".join(parts).encode(), key=key, digest_size=32).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), digest_size=64).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _like(c: str, stream: Stream, hexadecimal: bool = False) -> str:
    """A character of the same class, script and case."""
    if hexadecimal and c in "0123456789abcdef":
        return "0123456789abcdef"[stream.below(16)]
    if c.isdigit():
        return "0123456789"[stream.below(10)]
    if c.isalpha():
        letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцч", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[script(c)]
        new = letters[stream.below(len(letters))]
        return new.upper() if c.isupper() else new
    return c


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The normal form that stands for an entity."""
    s = Stream(key, kind, entity, str(attempt))
    if kind == "mail":
        local, domain = entity.split("@", 1)
        labels = domain.split(".")
        # A host is the same for all its addresses; reserved example hosts stay reserved.
        host = Stream(key, "host", domain)
        keep = 2 if domain.endswith((".example.com", ".example.org", ".example.net")) else 1
        new = ["".join(_like(c, host) for c in x) for x in labels[:-keep]] + labels[-keep:]
        return "".join(_like(c, s) for c in local) + "@" + ".".join(new)
    if kind == "secret":
        return "".join(_like(c, s, True) for c in entity)
    if kind == "key":
        kept = m[0] if (m := re.match(_PREFIX, entity)) else ""
        return kept + "".join(_like(c, s) for c in entity[len(kept):])
    if kind == "ip6":
        groups = ipaddress.IPv6Address(entity).exploded.split(":")
        return str(ipaddress.IPv6Address(":".join([groups[0], *("".join(_like("0", s, True) for _ in g) for g in groups[1:])])))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "account":
        body = "".join(_like(c, s) for c in entity[2:])
        # A valid number stays one.
        return entity[:2] + (f"{98 - remainder(entity[:2] + '00' + body[2:]):02d}" if remainder(entity) == 1 else body[:2]) + body[2:]
    if kind == "number:valid":
        body = str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in entity[2:])
        return body + str(-luhn(body + "0") % 10)
    if kind == "phone":
        code, digits = entity.split(":")
        return code + "".join(str(s.below(10)) for _ in digits[len(code):])
    if kind == "number":
        return "".join(str(s.below(10)) for _ in entity)
    role, *rest = kind.split(":")
    syllables, endings = SYLLABLES[rest[-1]]
    ends = endings[rest[0] if role == "first" else "n"]
    # Later attempts are longer, so names never run out.
    count = 2 + s.below(2) + attempt // 4
    return "".join(syllables[s.below(len(syllables))] for _ in range(count)) + ends[s.below(len(ends))]


def laid_out(kind: str, mention: str, new: str) -> str:
    """The surrogate in the layout of a mention."""
    if kind == "phone":
        # A mention may lack the country code or dial 00 before it.
        own = "".join(c for c in mention if c.isdigit())
        new = own[:max(0, len(own) - len(new))] + new[-len(own):]
    if kind in ("phone", "number", "number:valid", "account"):
        fresh = iter(new)
        return "".join(next(fresh) if c.isalnum() else c for c in mention)
    if kind in ("ip", "ip6", "key"):
        return new
    if kind in ("mail", "secret"):
        return new.upper() if mention.isupper() else new
    return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]


def replaced(text: str | None, key: bytes, attempt_of: Callable[[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the types of its entities."""
    if not text:
        return text, []
    out, at, kinds = [], 0, []
    for start, end, kind, entity in mentions(text):
        new = surrogate(key, kind, entity, attempt_of(kind, entity))
        out += [text[at:start], laid_out(kind, text[start:end], new)]
        at = end
        kinds.append(kind)
    return ("".join(out) + text[at:], kinds) if kinds else (text, kinds)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct kind, entity of all texts."""

    def run(batches):
        for batch in batches:
            found = {(k, e) for t in batch.column(0) if t.is_valid for _, _, k, e in mentions(t.as_py())}
            yield pa.record_batch([pa.array([x[i] for x in found], pa.string()) for i in range(2)], names=["kind", "entity"])

    return docs.select(docs[text].alias("t")).mapInArrow(run, "kind string, entity string").distinct()


def later_attempts(found: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt of the entities whose first surrogate is not theirs."""
    found = stored(found, "entities")

    def draw(batches):
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            new = [surrogate(key, *row) for row in rows]
            yield pa.record_batch([batch["kind"], batch["entity"], batch["attempt"], pa.array(new, pa.string())], names=["kind", "entity", "attempt", "new"])

    form = "kind string, entity string, attempt int, new string"
    return settled(found, lambda waiting: waiting.mapInArrow(draw, form))


def settled(found: DataFrame, draw: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """kind, entity, attempt of the entities that lose their first draw: rounds of drawing
    until all surrogates differ from each other and from all entities. Phones and other
    numbers are one family, in which digits must differ."""
    waiting, taken, late = found.withColumn("attempt", F.lit(0)), None, None
    family = F.when(F.col("kind").isin("phone", "number", "number:valid"), "digits").otherwise(F.col("kind")).alias("family")
    digits = F.when(F.col("kind") == "phone", F.substring_index("entity", ":", -1)).otherwise(F.col("entity")).alias("new")
    real_ones = found.select(family, digits).distinct()
    while True:
        drawn = stored(draw(waiting), "drawn")
        named = drawn.select("*", family)
        best = named.groupBy("family", "new").agg(F.min(F.struct("entity", "kind")).alias("first")).join(real_ones, ["family", "new"], "left_anti")
        if taken is not None:
            best = best.join(taken, ["family", "new"], "left_anti")
        best = best.select("family", "first.kind", "new", "first.entity")
        won = stored(best, "won")
        if late is None:
            late, taken = drawn.limit(0).select("kind", "entity", "attempt"), won.select("family", "new")
        else:
            own = drawn.join(won, ["kind", "new", "entity"], "left_semi").select("kind", "entity", "attempt")
            late, taken = late.unionByName(own), taken.union(won.select("family", "new"))
        waiting = drawn.join(won, ["kind", "new", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if waiting.limit(1).count() == 0:
            return stored(late, "late")


def pseudonymise(docs: DataFrame, key: bytes = b"panelkit", text: str = "text") -> DataFrame:
    """The rows with replaced texts, and n_entities and entity_kinds after all columns."""
    late = later_attempts(entities(docs, text), key)
    columns = docs.columns
    place = columns.index(text)
    form = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    few = late.limit(ENTITIES_SENT + 1).count() <= ENTITIES_SENT
    sent = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in late.collect()} if few else {})
    if few:
        rows = form.withColumn("late", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        def keyed(batches):
            for batch in batches:
                found = [(s, k, e) for s, t in zip(batch["s"].to_pylist(), batch["t"], strict=True) if t.is_valid
                         for k, e in {(k, e) for _, _, k, e in mentions(t.as_py())}]
                yield pa.record_batch([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["s", "kind", "entity"])

        digest = F.sha2(F.col(f"c{place}"), 256)
        named = form.select(digest.alias("s"), F.col(f"c{place}").alias("t")).mapInArrow(keyed, "s string, kind string, entity string").distinct()
        by_text = named.join(late, ["kind", "entity"]).groupBy("s").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("late"))
        rows = form.withColumn("s", digest).join(by_text, "s", "left").drop("s")

    def run(batches):
        for batch in batches:
            texts, kinds = [], []
            for t, own in zip(batch.column(place), batch["late"], strict=True):
                held = {(x["kind"], x["entity"]): x["attempt"] for x in own.as_py()} if own.is_valid else sent.value
                new, found = replaced(t.as_py(), key, lambda k, e, held=held: held.get((k, e), 0))
                texts.append(new)
                kinds.append(found)
            out = list(batch.columns[:-1])
            out[place] = pa.array(texts, pa.string())
            yield pa.record_batch([*out, pa.array([len(k) for k in kinds], pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
                                  names=[f"c{i}" for i in range(len(columns))] + ["n", "kinds"])

    kinds = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return rows.mapInArrow(run, f"{kinds}, n int, kinds array<string>").toDF(*columns, "n_entities", "entity_kinds")
