"""Personal data replaced by keyed surrogates of the same type, format, gender and script."""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import settle, unused

# Titles and common first names by gender; a name is looked for after one of them.
MALE_TITLES = frozenset("mr mister herr monsieur señor senor sr don sir господин".split())
FEMALE_TITLES = frozenset("mrs ms miss frau madame mme mademoiselle señora senora sra doña lady госпожа".split())
OTHER_TITLES = frozenset("dr prof professor".split())
MALE_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles peter paul george hans klaus jürgen wolfgang pierre jacques antoine "
    "jean-luc françois juan carlos josé luis miguel иван сергей дмитрий алексей андрей михаил николай пётр".split()
)
FEMALE_NAMES = frozenset(
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emily alice helga ursula ingrid greta marie camille juliette amélie "
    "chloé maría carmen lucía pilar isabel анна мария елена ольга наталья татьяна екатерина ирина".split()
)
# Titles that in capitals are hardly anything else.
_LOUD_TITLES = frozenset("mr mrs herr frau prof dr".split())
_TITLES = MALE_TITLES | FEMALE_TITLES | OTHER_TITLES
_FIRST_NAMES = MALE_NAMES | FEMALE_NAMES

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_IP = re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)")
_CARD = re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?![\d])")
_PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]?\d{4}(?![\w]|[.-]\d)|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?!\w)")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)\b)[\"']?\s*[=:]\s*[\"']?(?P<v>(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{8,})")
_ACCESS_KEY = re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![0-9A-Za-z])")
_KEY_BLOCK = re.compile(r"-----BEGIN (?P<of>[A-Z ]*PRIVATE KEY)-----(?P<v>[A-Za-z0-9+/=\s]*[A-Za-z0-9][A-Za-z0-9+/=\s]*)-----END (?P=of)-----")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
# A name begins with a capital of any script; one letter alone, as in O'Neill, has more behind an apostrophe.
_NAME = r"\p{Lu}(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|(?:['’-][^\W\d_]+)+)"
_CAPITALS = regex.compile(rf"(?<!\w)(?P<lead>\p{{Lu}}{_WORD})\.?[ \u00a0](?=(?P<rest>{_NAME}(?:[ \u00a0]{_NAME})?))")
_RUN = re.compile(r"\w+")
#: Rounds of drawing surrogates again.
MOST_ROUNDS = 100
#: Only texts with one of these are looked through for anything but names.
_TRACES = re.compile(r"[\d@=:]|AKIA|ASIA|-----BEGIN")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _ip6(text: str) -> str | None:
    """The written-out form of an IPv6 address that names a host, null for anything else."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return None if int(address) < 1 << 16 else address.exploded


def _gender(lead: str, first: str | None) -> str:
    if lead in MALE_TITLES or first in MALE_NAMES:
        return "m"
    return "f" if lead in FEMALE_TITLES or first in FEMALE_NAMES else "x"


def _script(word: str) -> str:
    if any("\u0400" <= c <= "\u04ff" for c in word):
        return "cyrillic"
    return "greek" if any("\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" for c in word) else "latin"


def _title_case(word: str) -> bool:
    return word[0].isupper() and not word.isupper()


def _all_capitals(word: str) -> bool:
    return word.isupper() and len(word) > 1


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    parts: dict[str, str] = {}
    for found in _CAPITALS.finditer(text):
        lead, rest = found["lead"], found["rest"].split()
        low = lead.casefold()
        titled = low in _TITLES
        if not titled and not (low in _FIRST_NAMES and _title_case(lead)):
            continue
        # Behind a title in capitals, names in capitals are names as well.
        loud = lead.isupper() and low in _LOUD_TITLES
        words = [w for k, w in enumerate(rest) if all(_title_case(r) or loud and _all_capitals(r) for r in rest[: k + 1])]
        if not words:
            continue
        given = words[0] if titled and len(words) > 1 else None if titled else lead
        last = words[-1] if titled else words[0]
        given, last = (part and (part.title() if _all_capitals(part) else part) for part in (given, last))
        if given:
            parts.setdefault(given, f"first:{_gender(low, given.casefold())}:{_script(given)}")
        parts.setdefault(last, f"last:{_script(last)}")
    # Every further mention of a part in this text, also in capitals, means the same person.
    kinds = {part.upper(): kind for part, kind in parts.items()} | parts
    starting: dict[str, list[str]] = {}
    for part in sorted(kinds, key=len, reverse=True):
        starting.setdefault(_RUN.match(part)[0], []).append(part)
    last = 0
    for run in _RUN.finditer(text) if parts else ():
        begin = run.start()
        for part in starting.get(run[0], ()) if begin >= last else ():
            end = begin + len(part)
            if text.startswith(part, begin) and not _RUN.match(text, end):
                yield begin, end, kinds[part], part.casefold()
                last = end
                break


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Personal data in a text as ``(begin, end, type, normal form)``, in order and apart.

    E-mail addresses, IPv4 and IPv6 addresses, card numbers with a valid check digit, IBANs likewise,
    phone and social security numbers, secrets (labelled, long hexadecimal strings, cloud access
    keys and private key blocks, each taken whole however long) and names after a title or a common
    first name. Names without either are not found. What has neither letter nor digit is no
    secret. Spellings of one entity share a normal form.
    """
    found: list[tuple[int, int, str, str]] = []
    if _TRACES.search(text):
        if "@" in text:
            found += [(m.start(), m.end(), "email", m[0].casefold()) for m in _EMAIL.finditer(text)]
        found += [(m.start(), m.end(), "iban", plain) for m in _IBAN.finditer(text) if len(plain := m[0].replace(" ", "")) >= 15 and _iban_rest(plain) == 1]
        found += [(m.start(), m.end(), "secret", m[0].casefold()) for m in _HEX.finditer(text)]
        found += [(m.start("v"), m.end("v"), "secret", m["v"]) for pattern in (_SECRET, _ACCESS_KEY, _KEY_BLOCK) for m in pattern.finditer(text)]
        found += [(m.start(), m.end(), "ip6", plain) for m in _IP6.finditer(text) if (plain := _ip6(m[0]))]
        found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
        found += [(m.start(), m.end(), "card", plain) for m in _CARD.finditer(text) if _luhn(plain := re.sub(r"\D", "", m[0]))]
        found += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0])) for m in _PHONE.finditer(text)]
    found += _names(text)
    apart: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for rank in ("email", "iban", "secret", "ip", "card", "ssn", "phone", "first", "last"):  # what overlaps goes to the first type
        mine = [e for e in found if e[2].startswith(rank)]
        if mine:
            spans = sorted(taken)
            apart += (kept := _free(sorted(set(mine)), spans))
            taken += [e[:2] for e in kept]
    return sorted(apart)


def _free(mine: list, spans: list[tuple[int, int]]) -> list:
    """Those of the sorted ``mine`` that overlap neither the sorted ``spans`` nor one before them."""
    kept, at, last = [], 0, -1
    for entity in mine:
        while at < len(spans) and spans[at][1] <= entity[0]:
            at += 1
        if entity[0] >= last and (at == len(spans) or spans[at][0] >= entity[1]):
            kept.append(entity)
            last = entity[1]
    return kept


class _Keyed:
    """A stream of choices that depends on the key, the entity and the attempt alone."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        digest = hmac.digest(key, f"{kind}\0{attempt}\0{normal}".encode(), "sha512")
        self._left = int.from_bytes(digest, "big")
        self._key, self._seed = key, digest

    def below(self, n: int) -> int:
        if self._left < n << 32:
            self._seed = hmac.digest(self._key, self._seed, "sha512")
            self._left = int.from_bytes(self._seed, "big")
        self._left, value = divmod(self._left, n)
        return value

    def one(self, choices) -> str:
        return choices[self.below(len(choices))]


_SYLLABLES = {
    "latin": [c + v for c in "b c d f g h l m n p r s t v".split() for v in "aeiou"],
    "cyrillic": [c + v for c in "б в г д к л м н п р с т".split() for v in "аеиоу"],
    "greek": [c + v for c in "β γ δ κ λ μ ν π ρ σ τ φ".split() for v in "αεηιο"],
}
_ENDINGS = {
    "latin": {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "elle", "ina"], "x": ["i", "en"], "last": ["son", "er", "ley", "man", "ton"]},
    "cyrillic": {"m": ["н", "р", "м"], "f": ["а", "ия", "на"], "x": ["и"], "last": ["ов", "ин", "енко", "ский"]},
    "greek": {"m": ["νος", "ρης"], "f": ["α", "ία"], "x": ["ι"], "last": ["ίδης", "άκης", "όπουλος"]},
}


def _shaped(text: str, draw: _Keyed) -> str:
    """Other letters for letters and digits for digits, everything else as it is."""
    return "".join(
        draw.one("0123456789") if c.isdecimal() else draw.one("abcdefghijklmnopqrstuvwxyz") if c.islower() or c.isalpha() and not c.isupper() else draw.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c
        for c in text
    )


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """The normal form that replaces ``normal``: same type and format, valid check digits, same gender and script.

    What may be of any length grows with the attempts, so that a short format is never used up.
    """
    draw = _Keyed(key, kind, normal, attempt)
    more = "".join(draw.one("abcdefghijklmnopqrstuvwxyz") for _ in range(attempt // 3))
    if kind == "email":
        local, domain = normal.split("@", 1)
        return f"{_shaped(local, draw)}{more}@{_shaped(domain.rpartition('.')[0], draw)}.{domain.rpartition('.')[2]}"
    if kind == "ip":
        private = ipaddress.ip_address(normal).is_private and attempt < 16
        return f"10.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}" if private else f"{11 + draw.below(89)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}"
    if kind == "ip6":
        return ":".join(["2001", "0db8", *("".join(draw.one("0123456789abcdef") for _ in range(4)) for _ in range(6))])
    if kind == "card":
        body = normal[0] + "".join(draw.one("0123456789") for _ in normal[1:-1])
        return next(body + d for d in "0123456789" if _luhn(body + d))
    if kind == "iban":
        body = _shaped(normal[4:], draw)
        return f"{normal[:2]}{98 - _iban_rest(normal[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        keep = max(0, len(normal) - 10)  # the country code
        return normal[:keep] + draw.one("23456789") + "".join(draw.one("0123456789") for _ in normal[keep + 1 :])
    if kind == "ssn":
        return ("9" if attempt < 16 else draw.one("0123456789")) + "".join(draw.one("0123456789") for _ in normal[1:])
    if kind == "secret":
        hexadecimal = _HEX.fullmatch(normal) is not None
        return "".join(draw.one("0123456789abcdef") for _ in normal) if hexadecimal else _shaped(normal, draw) + more
    script = kind.rpartition(":")[2]
    ending = "last" if kind.startswith("last") else kind.split(":")[1]
    stem = "".join(draw.one(_SYLLABLES[script]) for _ in range(2 + attempt // 2))
    return stem + draw.one(_ENDINGS[script][ending])


def dressed(mention: str, kind: str, replacement: str) -> str:
    """``replacement`` in the spelling of ``mention``: its separators, grouping and case."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(replacement)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind.startswith(("first", "last")):
        return replacement.upper() if mention.isupper() else replacement.capitalize() if mention[0].isupper() else replacement
    if kind == "ip" or len(mention) != len(replacement):  # folding case may change the length
        return replacement
    return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, replacement, strict=True))


def rewritten(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with its personal data replaced, and how many mentions that were."""
    out, last, found = [], 0, entities(text)
    for begin, end, kind, normal in found:
        replacement = surrogate(key, kind, normal, attempts.get((kind, normal), 0))
        out += [text[last:begin], dressed(text[begin:end], kind, replacement)]
        last = end
    return "".join([*out, text[last:]]) if found else text, len(found)


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(mark, kind, normal)``, distinct for each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(mark, kind, normal) for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind, normal in sorted({e[2:] for e in entities(text or "")})]
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "kind", "normal"])

    marked = docs.select(F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return marked.mapInArrow(task, "mark long, kind string, normal string")


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """Rows ``(kind, normal, attempt, surrogate)`` for the distinct entities of ``found``, all surrogates apart.

    A surrogate that two entities share, or that is itself an entity of the corpus, is drawn
    again for all but the first of them until none is left; names of one script are told apart
    whatever their kind. The space of names, addresses and secrets grows with the attempts.
    Numbers of a fixed format can be used up: after ``MOST_ROUNDS`` rounds that is an error that
    names an entity. Every round is a grouping over the entities, and settled.
    """

    @F.arrow_udf("string")
    def draw(kind: pa.Array, normal: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), normal.to_pylist(), attempt.to_pylist(), strict=True)
        return pa.array([surrogate(key, *row) for row in rows], pa.string())

    table = found.select("kind", "normal").distinct().withColumn("attempt", F.lit(0))
    table = settle(table.withColumn("surrogate", draw("kind", "normal", "attempt")), "surrogates")
    script = F.substring_index("kind", ":", -1)
    space = F.when(F.col("kind").startswith("first") | F.col("kind").startswith("last"), F.concat(F.lit("name:"), script)).otherwise(F.col("kind"))
    for _ in range(MOST_ROUNDS):
        named = table.withColumn("space", space)
        shared = named.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "normal")).alias("owner")).where("n > 1")
        late = named.join(shared, ["space", "surrogate"]).where("normal <> owner.normal OR kind <> owner.kind").select("kind", "normal")
        real = named.select("space", F.col("normal").alias("surrogate")).distinct()
        real = named.join(real, ["space", "surrogate"], "left_semi").select("kind", "normal")
        again = settle(late.unionAll(real).distinct(), "surrogates-again")
        if again.isEmpty():
            return table
        moved = table.join(again.withColumn("again", F.lit(1)), ["kind", "normal"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        new = F.when(F.col("again") == 1, draw("kind", "normal", "attempt")).otherwise(F.col("surrogate"))
        table = settle(moved.select("kind", "normal", "attempt", new.alias("surrogate")), "surrogates")
    kind, normal = again.first()
    raise ValueError(f"no surrogate is left for the {kind} {normal!r}")


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of every whole text replaced by surrogates.

    The same entity gets the same surrogate everywhere, different ones get different ones. Most
    surrogates follow from the key alone; the few drawn again after a collision are joined to the
    texts that mention them. Null texts stay null, other columns as they are, repeated rows each
    stay; an empty table stays empty. ``count_col`` names a column for the number of mentions.
    """
    mentions = settle(_mentions(docs, id_col, text_col), "mentions")
    moved = assigned(mentions, key).where("attempt > 0").select("kind", "normal", "attempt")
    per_text = mentions.join(moved, ["kind", "normal"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("moved"))
    per_text = settle(per_text, "surrogates-moved")

    @F.arrow_udf("struct<text: string, n: int>")
    def replace(texts: pa.Array, moved: pa.Array) -> pa.Array:
        new, counts = [], []
        for text, rows in zip(texts.to_pylist(), moved.to_pylist(), strict=True):
            attempts = {(row["kind"], row["normal"]): row["attempt"] for row in rows or ()}
            out, n = (None, 0) if text is None else rewritten(text, key, attempts)
            new.append(out)
            counts.append(n)
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(counts, pa.int32())], ["text", "n"])

    mark, new = unused(docs, "own_mark"), unused(docs, "replaced")
    own = docs.withColumn(mark, F.xxhash64(id_col, text_col))
    joined = own.join(per_text, own[mark] == per_text["mark"], "left").withColumn(new, replace(own[text_col], per_text["moved"]))
    columns = [F.col(f"{new}.text").alias(c) if c == text_col else own[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, *([F.col(f"{new}.n").alias(count_col)] if count_col else []))
