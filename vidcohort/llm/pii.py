"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over the text once and reports anchors: at-signs, plus signs before a digit, digits, the
``://`` behind a scheme, and cue words. Each anchor has a local parser that expands it to the left and right and validates
what it has found:

- ``email``: left over the local part, no further than the last address; right over labels.
- ``ip``, ``card``: from the first digit that no earlier candidate of the kind holds; parts up to 255; 13 to 19 digits and Luhn.
- ``phone``: from the plus sign; 9 to 15 digits.
- ``login``: what stands between ``://`` and the at-sign of a URL.
- ``iban``: behind its cue; two letters, two check digits, remainder of 97; the longest part that fits.
- ``account``: what a cue (account, passport, token, ...) names: letters, digits, ``_`` and ``-``, at least six of them and four digits.
- ``address``: a house number with one to three capitalised words and the kind of street, or the other way round.

The first four are the base and equal the leftmost non-overlapping matches of their patterns; the others add spans. Spans are
code points, end exclusive. Each text is read whole, by itself, in one pass; the automaton is of fixed size. Null texts are
empty and have no spans. Repeated rows, rows without id, extra columns and empty tables are fine: each row gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import give_back, read_table

#: Kinds in the order in which they are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "address")
#: Cue words of accounts, and of streets before and behind their name.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "token", "password", "secret", "api_key", "apikey")
STREET_AFTER = ("street", "avenue", "road", "boulevard", "lane", "drive")
STREET_BEFORE = ("rue", "calle", "avenida", "place")
STREET_WITHIN = ("straße", "strasse")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Letters on either side of a street's cue that its parser reads.
REACH = 80

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_login = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?@")
_iban = re.compile(r"[:=#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_account = re.compile(r"(?:\x20?(?:no|nr|number|id)\b\.?)?\x20?[:=#]?\x20?[\"']?([A-Za-z0-9][A-Za-z0-9_-]++)")
_number_before = re.compile(r"(?<![\w.])[0-9]{1,5}[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'-]*+ ){1,3}$")
_name_and_number = re.compile(r"(?: (?:de|du|des|la|del|el|los|las))*(?: [A-ZÀ-Þ][\w'-]*+){1,3},? [0-9]{1,5}[A-Za-z]?\b")
_only_number = re.compile(r" [0-9]{1,5}[A-Za-z]?\b")
_joined_name = re.compile(r"(?<!\w)[A-ZÀ-Þ][\w-]*+$")


def _cased(words: tuple[str, ...]) -> list[str]:
    return [f(w) for w in words for f in (str.lower, str.capitalize, str.upper)]


def luhn(digits: str) -> bool:
    odd, even = map(int, digits[-1::-2]), map(int, digits[-2::-2])
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def iban(value: str) -> bool:
    bare = value.replace(" ", "")
    return len(bare) >= 15 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def automaton():
    """Anchors with the name of their parser."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for name, words in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("after", STREET_AFTER), ("before", STREET_BEFORE), ("within", STREET_WITHIN)):
        for w in _cased(words):
            found.add_word(w, (name, len(w)))
    found.make_automaton()
    return found


class Finder:
    """Spans (kind number, start, end) of a text, in the order of kinds and starts."""

    def __init__(self):
        self.anchors = automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        out: set[tuple[int, int, int]] = set()
        mail = card = ip = 0  # what candidates of these kinds hold already
        for last, (name, length) in self.anchors.iter(text):
            i, end = last + 1 - length, last + 1
            if name == "digit":
                if i >= card:
                    m = _card.match(text, i)
                    card = m.end() if m else end
                    if m and 13 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
                        out.add((2, i, card))
                if i >= ip:
                    m = _ip.match(text, i)
                    ip = m.end() if m else self.run(text, i)
                    if m and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                        out.add((1, i, ip))
            elif name == "plus":
                m = _phone.match(text, i)
                if m and 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.add((3, i, m.end()))
            elif name == "at":
                start = i
                while start > mail and text[start - 1] in LOCAL:
                    start -= 1
                if start < i and (m := _domain.match(text, end)):
                    mail = m.end()
                    out.add((0, start, mail))
            elif name == "scheme":
                if i and text[i - 1].isalnum() and (m := _login.match(text, end)):
                    out.add((4, end, m.end() - 1))
            else:
                self.cue(text, name, i, end, out)
        return sorted(out)

    @staticmethod
    def run(text: str, i: int) -> int:
        """End of the digits at ``i``: an address that cannot start at the first of them cannot start at another."""
        while i < len(text) and "0" <= text[i] <= "9":
            i += 1
        return i

    @staticmethod
    def cue(text: str, name: str, i: int, end: int, out: set) -> None:
        free = not (i and (text[i - 1].isalnum() or text[i - 1] == "_")), not text[end : end + 1].isalnum()
        if name == "within":  # the end of a name
            m, number = _joined_name.search(text, max(0, i - REACH), end), _only_number.match(text, end)
            if m and number:
                out.add((7, m.start(), number.end()))
        elif not all(free):
            return
        elif name == "iban" and (m := _iban.match(text, end)):
            for stop in range(m.end(1), m.start(1) + 14, -1):
                if text[stop - 1] != " " and iban(text[m.start(1) : stop]):
                    out.add((5, m.start(1), stop))
                    break
        elif name == "account" and (m := _account.match(text, end)):
            if len(m[1]) >= 6 and sum("0" <= c <= "9" for c in m[1]) >= 4:
                out.add((6, m.start(1), m.end(1)))
        elif name == "after" and (m := _number_before.search(text, max(0, i - REACH), i)):
            out.add((7, m.start(), end))
        elif name == "before" and (m := _name_and_number.match(text, end)):
            out.add((7, i, m.end()))


_finders: list[Finder] = []


def finder() -> Finder:
    """The worker's finder."""
    if not _finders:
        _finders.append(Finder())
    return _finders[0]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and its spans (kind, start, end) of every row."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder()
        for texts in parts:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in find(t or "")] for t in texts], dtype=object)
        give_back()

    return docs.select("doc_id", "text", run(F.col("text").cast("string")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the texts replaced by its kind in angle brackets; of overlapping spans, the first and longest counts."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder()
        for texts in parts:
            out = []
            for t in texts:
                kept, at = [], 0
                for start, end, kind in sorted(((s, e, k) for k, s, e in find(t or "")), key=lambda x: (x[0], -x[1], x[2])):
                    if start >= at:
                        kept += [t[at:start], f"<{KINDS[kind]}>"]
                        at = end
                out.append(None if t is None else "".join([*kept, t[at:]]))
            yield pd.Series(out, dtype=object)
        give_back()

    return docs.withColumn("text", run(F.col("text").cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the lists are joined where they are made."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = finder()
        for texts in parts:
            rows = []
            for t in texts:
                found = find(t or "")
                listed = [f"{KINDS[k]}:{s}:{e}" for k, s, e in found]
                kinds = [k for k, *_ in found]
                base = ",".join(listed[: sum(k < 4 for k in kinds)])
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        give_back()

    return docs.select("doc_id", run(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return digests(read_table(spark, sf_dir, "documents"))
