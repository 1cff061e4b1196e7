"""Personal data and secrets in texts.

Regular expressions propose spans, each kind on its own; validators confirm them
(Luhn for cards, mod-97 for IBANs, ranges for addresses and identity numbers),
at shorter ends too where a reading fails. Words within
40 characters before or 20 after raise or lower the score. Spans under the
threshold are dropped; of overlapping ones the best (then longest, then first)
stays. Offsets count characters of the whole text.

Defined results: a null or empty text has no spans; each repeated row gives its
own; null ids are carried; an empty table gives none. Other columns are ignored
by find_spans and kept by redact, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.common import field, map_batches, name_of, table

THRESHOLD = 0.5
BEFORE, AFTER = 40, 20

DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
#: The end of what may stand before the @ of an address, read backwards in pieces.
LOCAL_END, PIECE = re.compile(r"[\w.%+-]*\Z"), 64
#: Runs of characters that numbers are written with; all numeric kinds lie within one.
CLUSTER = re.compile(r"[\d(+][\d ().+-]{6,}")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w)])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
#: Of no fixed length, so its end is found by trying group bounds, as a card's is.
WORLD_PHONE = re.compile(r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)")
LONGEST_PHONE = 40
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w)")
#: Groups of digits that cards are printed in.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
IBAN = re.compile(r"(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}|[a-z]{2}\d{2}(?: ?[a-z0-9]){11,30})")
#: Small letters are taken for an IBAN in one piece or in groups of four only.
FOURS = re.compile(r"(?:[a-z0-9]{4} )*[a-z0-9]{1,4}|[a-z0-9]+")
SECRET = re.compile(r"(?<!\w)(?:(?P<prefixed>AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)")
#: Lengths of IBANs by country, of the registry.
IBAN_LENGTH = {
    c: int(n)
    for c, n in (
        x.split(":")
        for x in (
            "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 "
            "GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 "
            "PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30"
        ).split()
    )
}
#: Of other countries, any length that mod-97 confirms counts, at this score.
UNLISTED_IBAN = 0.55
BASE = {"email": 0.9, "ipv4": 0.6, "ssn": 0.45, "phone": 0.65, "card": 0.8, "iban": 0.9, "secret": 0.35}
#: Secrets that show by their prefix what they are.
PREFIXED = 0.65
HELP = {
    "email": {"mail", "email", "contact"},
    "ipv4": {"ip", "address", "host", "server", "login"},
    "ssn": {"ssn", "social", "security", "tax", "identity"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment"},
    "iban": {"iban", "account", "bank", "konto"},
    "secret": {"token", "key", "secret", "password", "passwd", "api", "apikey", "bearer", "credential"},
}
HURT = {"isbn", "issn", "version", "release", "invoice", "order", "sku", "commit", "sha", "checksum", "md5", "hash"}
WORD = re.compile(r"[a-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _valid(kind: str, s: str) -> bool:
    if kind == "card":
        d = s.replace(" ", "").replace("-", "")
        return d.isascii() and len(set(d)) > 1 and luhn(d)
    if kind == "ipv4":
        return s.isascii() and all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split("."))
    if kind == "ssn":
        a, b, c = s.split("-")
        return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"
    if kind == "phone":
        return 8 <= sum(c.isdigit() for c in s) <= 15
    return True


def _each(pattern: re.Pattern, text: str, start: int, stop: int):
    """Matches from every place where one may begin, overlapping ones too."""
    m = pattern.search(text, start, stop)
    while m:
        yield m
        m = pattern.search(text, m.start() + 1, stop)


def _ends(kind: str, pattern: re.Pattern, text: str, m: re.Match) -> list[int]:
    """Ends of the valid readings of a match, at bounds of its groups, longest first."""
    a, b = m.span()
    ends = [b] + [e for e in range(b - 1, a, -1) if text[e] in " .-" and text[e - 1].isdigit() and pattern.fullmatch(text, a, e)]
    return [e for e in ends if _valid(kind, text[a:e])]


def _numbers(text: str, start: int, stop: int):
    """Each kind is looked for on its own. What has a fixed form comes first; a
    card in other groups must not overlap it, and a phone must not end within it."""
    firm = [("ipv4", *m.span()) for m in _each(IPV4, text, start, stop) if _valid("ipv4", m[0])]
    firm += [("ssn", *m.span()) for m in _each(SSN, text, start, stop) if _valid("ssn", m[0])]
    firm += [("phone", *m.span()) for m in _each(PHONE, text, start, stop)]
    loose = []
    for m in _each(CARD, text, start, stop):
        a = m.start()
        after_plus = text[a - 1 : a] == "+"
        for b in _ends("card", CARD, text, m):
            groups = tuple(map(len, re.split("[ -]", text[a:b])))
            if groups in CARD_GROUPS or len(groups) == 1 and not after_plus:
                firm.append(("card", a, b))
            elif not after_plus:
                loose.append(("card", a, b))
    world = [(m.start(), _ends("phone", WORLD_PHONE, text, m)) for m in _each(WORLD_PHONE, text, start, stop)]
    firm.sort(key=lambda f: f[1:])
    starts, reach = _reach([f[1:] for f in firm])
    world = [(s, p) for s, p in world if p]
    begins, shortest = _reach([(s, p[-1]) for s, p in world])
    for k, a, b in loose:
        # no card begins within a phone, unless a whole phone is left before it
        i, j = bisect_left(starts, b), bisect_left(begins, a)
        if (i == 0 or reach[i - 1] <= a) and (j == 0 or shortest[j - 1] <= a):
            yield k, a, b
            while j and begins[j - 1] > a - LONGEST_PHONE:
                j -= 1
            while j < len(world) and begins[j] < b:
                world[j] = (world[j][0], [e for e in world[j][1] if not a < e < b])
                j += 1
    phones = []
    for s, p in world:
        for end in p:
            i, j = bisect_right(starts, s), bisect_left(starts, end)
            if i == j or all(firm[x][2] <= end for x in range(i, j)):
                phones.append((s, end))
                yield "phone", s, end
                break
    begins, reach = _reach(phones)
    for k, a, b in firm:
        i = bisect_right(begins, a)
        if k != "phone" or i == 0 or reach[i - 1] < b:
            yield k, a, b


def _reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order of start, and the furthest end up to each."""
    return [s for s, _ in spans], list(accumulate((e for _, e in spans), max))


def _iban_end(text: str, m: re.Match) -> int | None:
    """Where an IBAN ends: at its country's length, or for an unlisted country at
    the longest end that mod-97 confirms. Small letters need a listed country."""
    want, n, ends = IBAN_LENGTH.get(m[0][:2].upper()), 0, []
    small = m[0][0].islower()
    if small and not want:
        return None
    for end, c in enumerate(m[0], m.start() + 1):
        n += c != " "
        if c != " " and (n == want if want else n >= 15) and not text[end : end + 1].isalnum():
            ends.append(end)
    ends = [e for e in ends if not small or FOURS.fullmatch(text, m.start(), e)]
    return next((e for e in reversed(ends) if mod97(text[m.start() : e].replace(" ", ""))), None)


def _local_start(text: str, at: int) -> int:
    """Where the local part of an address with its @ at `at` begins; `at` if there is none."""
    lo = at
    while lo:
        from_ = max(0, lo - PIECE)
        n = lo - LOCAL_END.search(text, from_, lo).start()
        lo -= n
        if n < PIECE:
            break
    while lo < at and text[lo] == ".":
        lo += 1
    return lo


def _candidates(text: str):
    at = text.find("@")
    while at >= 0:
        d = DOMAIN.match(text, at + 1)
        start = _local_start(text, at) if d else at
        if start < at:
            yield "email", start, d.end(), BASE["email"]
        at = text.find("@", at + 1)
    ibans = []
    m = IBAN.search(text)
    while m:
        end = _iban_end(text, m)
        if end:
            ibans.append((m.start(), end))
            yield "iban", m.start(), end, BASE["iban"] if m[0][:2].upper() in IBAN_LENGTH else UNLISTED_IBAN
        m = IBAN.search(text, end or m.start() + 1)
    for m in CLUSTER.finditer(text):
        # two more characters for what the patterns look ahead to
        for k, a, b in _numbers(text, m.start(), m.end() + 2):
            if k != "card" or not any(x <= a and b <= y for x, y in ibans):
                yield k, a, b, BASE[k]
    for m in SECRET.finditer(text):
        yield "secret", m.start(), m.end(), PREFIXED if m["prefixed"] else BASE["secret"]


def score(kind: str, text: str, start: int, end: int, base: float) -> float:
    near = WORD.findall(text[max(0, start - BEFORE) : start].lower()) + WORD.findall(text[end : end + AFTER].lower())
    s = base + (0.3 if HELP[kind].intersection(near) else 0.0)
    if kind != "email" and HURT.intersection(near):
        s -= 0.3
    return round(min(1.0, max(0.0, s)), 2)


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """start, end, kind, score of each span of a text, in order."""
    if not text:
        return []
    found = [(score(k, text, a, b, base), a, b, k) for k, a, b, base in _candidates(text)]
    kept: list[tuple[int, int, str, float]] = []
    for s, a, b, k in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if s >= threshold:
            i = bisect_left(kept, (a, b))
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
                kept.insert(i, (a, b, k, s))
    return kept


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, kind, start, end, score: one row for each span."""
    key, text = name_of(df, key), name_of(df, text)
    kind = df.schema[key].dataType.simpleString()

    def make():
        def fn(b: pa.RecordBatch):
            rows, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s in spans(t, threshold):
                    rows.append(i)
                    out.append(s)
            start, end, name, points = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(points, pa.float64())],
                ["key", "kind", "start", "end", "score"],
            )

        return fn

    out = map_batches(df.select(field(df, key).alias("key"), field(df, text).alias("text")), make, f"key {kind}, kind string, start int, end int, score double")
    return out.withColumnRenamed("key", key)


def redact_text(text: str | None, threshold: float = THRESHOLD) -> str | None:
    found = spans(text, threshold)
    if not found:
        return text
    parts, at = [], 0
    for a, b, k, _ in found:
        parts += (text[at:a], f"[{k.upper()}]")
        at = b
    return "".join(parts) + text[at:]


def redact(df: DataFrame, text: str = "text", chars: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with each span replaced by its kind in brackets; `chars` names a column
    that holds the text's length and follows it."""
    where = df.columns.index(name_of(df, text))
    count = df.columns.index(chars) if chars in df.columns else None

    def make():
        def fn(b: pa.RecordBatch):
            old = b.column(where).to_pylist()
            new = [redact_text(t, threshold) for t in old]
            cols = list(b.columns)
            cols[where] = pa.array(new, cols[where].type)
            if count is not None:
                was = cols[count].to_pylist()
                cols[count] = pa.array([len(t) if t is not s and t is not None else n for s, t, n in zip(old, new, was)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

        return fn

    return map_batches(df, make, df.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, chars="n_chars")
