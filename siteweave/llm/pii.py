"""Surrogates for personal data: keyed, of the same type and form, distinct and consistent.

Entities found in the texts become one row each per type and canonical form, so
an entity has one surrogate wherever it appears (coreference).  The surrogate
is drawn from a keyed hash of the canonical form: e-mails keep their shape,
phones their country code and punctuation, addresses of a network stay
addresses, card and account numbers stay valid, secrets keep length and
alphabet, names keep script, case and gender.  A given name is one entity
whatever its titles are; its gender is that of most texts that show one.  A name
is known by a title, titles in a row being one, and does not cross a line end;
once known it is one wherever it stands in the same text with a capital.  Two
checks run as joins over all entities until nothing is left to change: no two entities of a type share a
surrogate, and no surrogate is an entity of the corpus.

The key comes from the caller: whoever has it can draw the surrogates again.

Defined cases: a null text stays null, an empty one empty; repeated rows get
the same text; matches that overlap go to the one that starts first, then to
the type named first; extra columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import store

#: setting of the session that names the key
KEY_SETTING = "spark.siteweave.surrogate.key"
# fixed values: titles that show a person's name, by gender; "M" only with a full stop
TITLES = {"m": ("Mr", "M", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Sig", "Господин", "Κύριος", "Κύριο"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Mademoiselle", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"), "n": ("Dr", "Prof")}
_TITLE = "|".join(r"M(?=\.)" if t == "M" else t for ts in TITLES.values() for t in ts)
#: between the words of a name: no line end
_GAP = r"[ \t\u00A0]"
# fixed values: country codes of two digits; 1 and 7 have one digit, all others three
CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:sk|ghp|gho|xox[bp]|glpat)[-_](?=[_-]*[A-Za-z0-9])[A-Za-z0-9_-]{16,}"
              r"|(?i:(?<=\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?))(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{8,}"
              r"|(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?=[+/=\s]*[A-Za-z0-9])[A-Za-z0-9+/=\s]+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
          r"|(?<![\w:.])(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|[23f][0-9a-f]{3}(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?!\w|:\w)",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])|(?<![\w-])3\d{3}[ -]\d{6}[ -]\d{4,5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"
             r"|(?<![\w.+(-])(?=\(?0(?:\)? ?[.-]?\d){9,10}(?![ .-]?\d))(?:\(0\d{1,4}\) ?|0\d{1,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w-])",
    "name": rf"(?<=\b(?:{_TITLE})\.?{_GAP})(?!(?:{_TITLE})\b)\p{{Lu}}[\p{{L}}'’-]+(?:{_GAP}(?!(?:{_TITLE})\b)\p{{Lu}}[\p{{L}}'’-]+)?",
}
FOUND = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: every entity has one of these in it or, for secrets and names, right before it; a text without any never reaches Python
SPOT = rf"[0-9@=:]|(?=[AsgxP])(?:AKIA|ASIA|sk[-_]|gh[po][-_]|xox[bp][-_]|glpat[-_]|PRIVATE KEY)|(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?:{_TITLE})\.?{_GAP}"
_SPOT = re.compile(SPOT)
#: after so many attempts, and again after as many more, a surrogate is one character or syllable longer: few forms may all be taken
WIDEN = 8
#: characters around a spot that are searched, and then on to the next white space
AROUND = 100
_CAPITAL = regex.compile(r"(?<![\p{L}\p{N}_@'’-])\p{Lu}[\p{L}'’-]+(?![\p{N}_@])")
_GENDER = regex.compile(rf"(?:\b({_TITLE})\.?{_GAP})+$")
# fixed values: endings of made-up given names by gender and script
ENDINGS = {"latin": {"m": "on", "f": "a", "n": "e"}, "cyrillic": {"m": "ор", "f": "а", "n": "е"}, "greek": {"m": "ος", "f": "α", "n": "ι"}}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(int(c) for c in digits[::-2]) + doubled) % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The check digits of an account number: the whole, country and check last, leaves 1 when divided by 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country) + '00') % 97:02d}"


def code_length(digits: str) -> int:
    """Digits of the country code that a number begins with."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in CODES else 3


def entity(kind: str) -> str:
    """The type of an entity: a given name is one whatever the gender of its title."""
    return kind.split("_")[0]


def session_key(spark: SparkSession) -> str:
    """The key that the session's owner has set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING}, or pass a key")
    return key


def _matches(text: str) -> Iterator[regex.Match]:
    """Matches of the patterns, searched around spots only; no entity crosses white space further than from spot to spot."""
    if "PRIVATE KEY" in text:
        yield from FOUND.finditer(text)
        return
    begin = end = 0
    for spot in _SPOT.finditer(text):
        if spot.start() >= end:
            if end:
                yield from FOUND.finditer(text, begin, end)
            begin = _cut(text, max(end, spot.start() - AROUND), end, -1)
        if spot.end() + AROUND // 2 > end:
            end = _cut(text, min(len(text), spot.end() + AROUND), len(text), 1)
    if end:
        yield from FOUND.finditer(text, begin, end)


def _cut(text: str, at: int, limit: int, step: int) -> int:
    """The nearest white space from ``at`` on, in the direction of ``step``."""
    while at != limit and not text[at - (step < 0)].isspace():
        at += step
    return at


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, type and canonical form of each entity."""
    out = []
    for m in _matches(text):
        kind, value = m.lastgroup, m[0]
        if kind in ("email", "ip"):
            value = value.lower()
        elif kind in ("card", "ssn", "phone", "iban"):
            value = regex.sub(r"[^\p{L}\d+]", "", value)
        elif kind == "name":
            # given name and surname are entities of their own: "Mr John Smith" and "Mr Smith" stay one person
            titles = _GENDER.search(text[max(0, m.start() - 40): m.start()])
            gender = next((g for g in "mf" if titles and any(t in TITLES[g] for t in titles.captures(1))), "n")
            words = list(regex.finditer(r"\S+", value))
            for k, w in enumerate(words):
                word = _own(w[0])
                out.append((m.start() + w.start(), m.start() + w.start() + len(word), "surname" if k == len(words) - 1 else f"given_{gender}", word.lower()))
            continue
        out.append((m.start(), m.end(), kind, value))
    return _named_again(text, out)


def _own(word: str) -> str:
    """A name without the ending of its genitive."""
    return regex.sub(r"['’-]+s?$", "", word)


def _named_again(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Adds the names that stand with a title somewhere in the text wherever else they stand in it, with a capital."""
    names: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind.startswith(("given", "surname")):
            names.setdefault(value, kind)
    if not names:
        return found
    out, k = [], 0
    for m in _CAPITAL.finditer(text):
        word = _own(m[0])
        value = word.lower()
        if value not in names:
            continue
        end = m.start() + len(word)
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or found[k][0] >= end:
            out.append((m.start(), end, names[value], value))
    return sorted(found + out)


class Draw:
    """Digits and letters from a keyed hash, as many as are asked for."""

    def __init__(self, key: str, kind: str, value: str, attempt: int) -> None:
        self.seed, self.n, self.pool = f"{kind}\0{value}\0{attempt}".encode(), 0, 0
        self.key = key.encode()

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            more = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n, self.pool = self.n + 1, self.pool << 256 | int.from_bytes(more, "big") | 1 << 255
        self.pool, x = divmod(self.pool, n)
        return x

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Each letter or digit by another of its kind, the rest as it is."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif hexadecimal and c in "abcdef":
                out.append("abcdef"[self.below(6)])
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            elif c.isalpha():
                low, high = ("а", "я") if "Ѐ" <= c <= "ӿ" else ("α", "ω") if "Ͱ" <= c <= "Ͽ" else ("à", "ö")
                x = chr(ord(low) + self.below(ord(high) - ord(low) + 1))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    """Canonical form of the replacement."""
    draw = Draw(key, kind, value, attempt)
    more = attempt // WIDEN
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{draw.like(local + 'x' * more)}@mail{draw.below(10 ** 6)}.example.{'com' if domain.endswith('.com') else 'org'}"
    if kind == "ip":  # the reserved block 240.0.0.0/4 names no machine
        if more or ":" in value:  # the documentation block of IPv6
            return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
        return ".".join(str(x) for x in (240 + draw.below(15), draw.below(256), draw.below(256), draw.below(256)))
    if kind == "card":
        body = value[0] + draw.like(value[1:-1] + "0" * more)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == luhn(value))
    if kind == "ssn":  # numbers from 900 are not issued
        return "9" + draw.like(value[1:] + "0" * more)
    if kind == "phone":
        keep = 1 + code_length(value[1:]) if value.startswith("+") else 1 if value.startswith("0") else 0
        return value[:keep] + draw.like(value[keep:] + "0" * more)
    if kind == "iban":
        account = draw.like(value[4:] + "0" * more)
        return value[:2] + (iban_check(value[:2], account) if iban_check(value[:2], value[4:]) == value[2:4] else draw.like(value[2:4])) + account
    if kind.startswith(("given", "surname")):
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", value) else "greek" if regex.search(r"\p{Greek}", value) else "latin"
        word = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(4 + more))
        return word + ("" if kind == "surname" else ENDINGS[script][kind[-1]])
    hexadecimal = not regex.search(r"[^0-9a-f]", value)
    prefix = regex.match(r"AKIA|ASIA|(?:sk|ghp|gho|xox[bp]|glpat)[-_]", value)
    at = prefix.end() if prefix else 0
    return value[:at] + draw.like(value[at:] + "0" * more, hexadecimal)


def dress(kind: str, said: str, canonical: str) -> str:
    """The canonical surrogate in the punctuation and case of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(canonical)
        return "".join(next(rest, "") if c.isalnum() or c == "+" else c for c in said) + "".join(rest)
    if kind == "email":
        return canonical.upper() if said.isupper() else canonical
    if kind.startswith(("given", "surname")):
        return canonical.upper() if said.isupper() and len(said) > 1 else canonical.capitalize()
    return canonical


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(__text_key, kind, value)`` of all texts; the key is the text's hash."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, kind, value) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, kind, value in find(text)}
            out = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                                             ["__text_key", "kind", "value"])

    rows = docs.where(F.col(text_col).rlike(SPOT)).select(F.xxhash64(text_col).alias("__text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "__text_key bigint, kind string, value string")


def settled(found: DataFrame) -> DataFrame:
    """Distinct ``(kind, value)`` of all mentions; a given name has one kind, by the gender that more texts show (neither, if equal)."""
    given = F.col("kind").startswith("given_")
    said = [F.count_if(F.col("kind") == f"given_{g}").alias(g) for g in "mf"]
    names = found.where(given).groupBy("value").agg(*said)
    kind = F.when(F.col("m") > F.col("f"), "given_m").when(F.col("f") > F.col("m"), "given_f").otherwise("given_n")
    return found.where(~given).select("kind", "value").distinct().unionByName(names.select(kind.alias("kind"), "value"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, value)`` to ``(kind, value, surrogate)`` without two equal surrogates or one that is an entity."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [surrogate(key, *row) for row in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], ["kind", "value", "attempt", "surrogate"])

    def draw(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(task, "kind string, value string, attempt int, surrogate string")

    now = store(draw(entities.select("kind", "value", F.lit(0).alias("attempt"))), "surrogates")
    while True:
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
        real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        judged = now.withColumn("turn", F.row_number().over(first)).join(real, ["kind", "surrogate"], "left")
        judged = store(judged.withColumn("bad", (F.col("turn") > 1) | F.col("real").isNotNull()), "judged")
        if not judged.where("bad").limit(1).count():
            return judged.select("kind", "value", "surrogate")
        again = draw(judged.where("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        now = store(judged.where("not bad").select("kind", "value", "attempt", "surrogate").unionByName(again), "surrogates")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text_col``; adds ``n_entities`` (a column of that name is replaced).

    Texts without a possible entity never leave the JVM and are not shuffled.
    """
    base = docs.drop("n_entities")
    found = store(mentions(base, text_col), "mentions")
    table = assign(store(settled(found), "entities"), key)
    base_kind = F.substring_index("kind", "_", 1).alias("kind")
    table = table.select(base_kind, "value", "surrogate")
    entry = F.struct("kind", "value", "surrogate")
    by_text = found.select("__text_key", base_kind, "value").distinct().join(table, ["kind", "value"]).groupBy("__text_key").agg(F.collect_set(entry).alias("__entries"))  # entities of one text
    by_text = store(by_text, "by_text")
    maybe = F.coalesce(F.col(text_col).rlike(SPOT), F.lit(False))
    plain = base.where(~maybe).withColumn("n_entities", F.lit(0).cast("bigint"))
    held = base.where(maybe).withColumn("__own_key", F.xxhash64(text_col)).join(by_text, F.col("__own_key") == F.col("__text_key"), "left").drop("__own_key", "__text_key")
    schema = plain.schema
    place = base.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in scan.slices(batches, text_col):
            texts, counts = [], []
            for text, entries in zip(rows.column(place).to_pylist(), rows.column(rows.num_columns - 1).to_pylist()):
                names = {(e["kind"], e["value"]): e["surrogate"] for e in entries or ()}
                out, at, n = [], 0, 0
                for start, end, kind, value in find(text) if names else ():
                    out += [text[at:start], dress(kind, text[start:end], names[entity(kind), value])]
                    at, n = end, n + 1
                texts.append("".join(out) + text[at:])
                counts.append(n)
            columns = list(rows.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [f.name for f in schema])

    return plain.unionByName(held.mapInArrow(task, schema))
