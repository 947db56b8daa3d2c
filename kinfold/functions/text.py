"""Cleaning, match keys and name comparison."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.config import PLACEHOLDER_SSNS

NO_LETTERS = "0000"


#: White space and NUL, as the trimming of source values takes them.
BLANKS = " \t\n\r\x0b\x0c\x00"


def clean(c: Column) -> Column:
    """Trim blanks, line ends, tabs and NULs; nothing left is null."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def clean_date(c: Column) -> Column:
    """A date; null for empty, zero and unparseable ones."""
    text = clean(c)
    return F.when(~text.startswith("0000"), text.try_cast("date"))


def clean_timestamp(c: Column) -> Column:
    text = clean(c)
    return F.when(~text.startswith("0000"), text.try_cast("timestamp"))


def match_key(c: Column) -> Column:
    """What two values must share to be equal for matching: case and outer blanks are ignored, blank is null."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def name_norm(c: Column) -> Column:
    """Dots and white space as one blank, lower case; blank is null."""
    return F.nullif(F.trim(F.lower(F.regexp_replace(c, r"[.\s]+", " "))), F.lit(""))


def soundex_letters(c: Column) -> Column:
    """Soundex of the letters only; `NO_LETTERS` for a name without ASCII letters."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return F.when(letters == "", F.lit(NO_LETTERS)).otherwise(F.soundex(letters))


def block_key(last_name: Column, raw_dob: Column) -> Column:
    """Soundex of the surname and the first four characters of the date as given; null without a surname."""
    given = F.nullif(raw_dob.cast("string"), F.lit(""))
    year = F.coalesce(F.substring(given, 1, 4), F.lit("____"))
    return F.when(clean(last_name).isNotNull(), F.concat(soundex_letters(clean(last_name)), F.lit("|"), year))


def middle_compatible(a: Column, b: Column, norm: Callable[[Column], Column] = name_norm) -> Column:
    a, b = norm(a), norm(b)
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    return a.isNull() | b.isNull() | F.when(initial, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise(a == b)


def suffix_compatible(a: Column, b: Column, norm: Callable[[Column], Column] = name_norm) -> Column:
    a, b = norm(a), norm(b)
    return a.isNull() | b.isNull() | (a == b)


def dob_compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.year(a) == F.year(b))


def dob_conflicts(a: Column, b: Column) -> Column:
    return F.coalesce(F.year(a) != F.year(b), F.lit(False))


def same_name(a: Column, b: Column, norm: Callable[[Column], Column] = name_norm) -> Column:
    return F.coalesce(norm(a) == norm(b), F.lit(False))


def jaro_winkler_one(a: bytes, b: bytes) -> float:
    """Jaro-Winkler over bytes. Half transpositions count as such, and the prefix boost holds at every similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, u in zip(b, used, strict=True) if u]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """`jaro_winkler_one` in expressions, null as empty. Equal strings are decided first: a Python function would be given
    all rows, whatever branch it stands in."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    both = F.struct(*[F.regexp_extract_all(F.hex(c), F.lit(".."), 0).alias(n) for n, c in (("x", a), ("y", b))])
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.transform(F.array(both), lambda s: _jaro_winkler_bytes(s["x"], s["y"]))[0])


def _jaro_winkler_bytes(x: Column, y: Column) -> Column:
    n, m = F.size(x), F.size(y)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)

    def take(used: Column, i: Column) -> Column:
        """The places of `y` that the bytes so far have taken, -1 for a byte that has none."""
        free = lambda j: (j <= i + reach) & (j >= i - reach) & (F.get(y, j) == F.get(x, i)) & ~F.array_contains(used, j)
        return F.concat(used, F.array(F.coalesce(F.get(F.filter(F.sequence(F.lit(0), m - 1), free), F.lit(0)), F.lit(-1))))

    def value(used: Column) -> Column:
        left = F.filter(x, lambda _, i: F.get(used, i) >= 0)
        right = F.transform(F.array_sort(F.filter(used, lambda j: j >= 0)), lambda j: F.get(y, j))
        k, t = F.size(left), F.size(F.filter(F.zip_with(left, right, lambda u, v: u != v), lambda v: v)) / 2
        jaro = (k / n + k / m + (k - t) / k) / 3
        same = lambda c, i: F.when((c == i) & F.coalesce(F.get(x, i) == F.get(y, i), F.lit(False)), c + 1).otherwise(c)
        prefix = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), same)
        whole = F.transform(F.array(jaro), lambda v: v + prefix * F.lit(0.1) * (1 - v))[0]
        return F.when(k == 0, 0.0).otherwise(whole)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), take, value)


def shard_of(c: Column, shards: int) -> Column:
    """The shard of a value: CRC-32 of its bytes modulo the number of shards."""
    return F.crc32(c.cast("string").cast("binary")) % shards


def ssn_hash(ssn: Column, key: str) -> Column:
    return F.sha2(F.concat(ssn, F.lit(key)).cast("binary"), 512)


def ssn_candidates(ssn: str, key: str | None) -> list[str]:
    """Hashes that a number may be stored under: as given, digits only, and dashed if it has nine digits."""
    if not key:
        return []
    digits = re.sub(r"\D+", "", ssn)
    forms = [ssn, digits]
    if len(digits) == 9:
        forms.append(f"{digits[:3]}-{digits[3:5]}-{digits[5:]}")
    forms = list(dict.fromkeys(f for f in forms if f))
    return [hashlib.sha512((f + key).encode()).hexdigest() for f in forms]


def ssn_unavailable_reason(key: str | None) -> str | None:
    """Why SSNs cannot be searched by; null if they can."""
    return None if key else "no SSN key is configured"


def placeholder_hashes(key: str | None, placeholders: tuple[str, ...] = PLACEHOLDER_SSNS) -> list[str]:
    return list(dict.fromkeys(h for p in placeholders for h in ssn_candidates(p, key)))
