"""Masking expressions (K1-K15) as native Spark columns.

``mask(c, type, strategy)`` picks the expression at plan time; nothing runs per row in Python.
Null stays null and blank text stays as it is under every strategy (K15, A3).
Random strategies are keyed draws of ``xxhash64(value, seed, position)``: the same value gives
the same output within a run, and a task retry reproduces it exactly (A7).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import WS, is_blank, strip_ws
from .predicates import PHONE_STRIP

# Masking strategies and the remove marker.
STRATEGIES = ("partial", "hash", "random", "remove")
REMOVED_MARKER = "[已删除]"

# Random phone prefixes, e-mail domains, name characters, random-text alphabet.
PHONE_PREFIXES = [
    "130", "131", "132", "133", "134", "135", "136", "137", "138", "139",
    "150", "151", "152", "153", "155", "156", "157", "158", "159",
    "180", "181", "182", "183", "184", "185", "186", "187", "188", "189",
]
EMAIL_DOMAINS = ["example.com", "test.com", "demo.org", "sample.net"]
SURNAMES = ["张", "李", "王", "刘", "陈", "杨", "赵", "黄", "周", "吴"]
GIVEN_NAMES = ["伟", "芳", "娜", "敏", "静", "丽", "强", "磊", "军", "洋"]
ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DIGITS = "0123456789"
ID_LAST = "0123456789X"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def _len(c: Column) -> Column:
    return F.char_length(c)


def _left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _right(c: Column, n: int) -> Column:
    return F.substring(c, -n, n)


# --- partial (K1-K6) -------------------------------------------------------------------

def mask_phone(v: Column) -> Column:
    """K1: strip whitespace - ( ) +; 11+ chars keep first 3 and last 4, else all stars."""
    c = F.regexp_replace(v, PHONE_STRIP, "")
    return F.when(_len(c) >= 11, F.concat(_left(c, 3), F.lit("****"), _right(c, 4))).otherwise(stars(_len(c)))


def mask_id_card(v: Column) -> Column:
    """K2: remove spaces; 18+ keep 6 + 8 stars + 4; 15+ keep 6 + 5 stars + 4; else stars."""
    c = F.regexp_replace(v, " ", "")
    n = _len(c)
    return (
        F.when(n >= 18, F.concat(_left(c, 6), F.lit("********"), _right(c, 4)))
        .when(n >= 15, F.concat(_left(c, 6), F.lit("*****"), _right(c, 4)))
        .otherwise(stars(n))
    )


def mask_email(v: Column) -> Column:
    """K3: user part of 2 or fewer chars all stars, else first 2 + stars; domain kept."""
    at = F.instr(v, "@")
    user = F.substr(v, F.lit(1), at - 1)
    domain = F.substr(v, at + 1, _len(v))
    ulen = _len(user)
    masked_user = F.when(ulen <= 2, stars(ulen)).otherwise(F.concat(_left(user, 2), stars(ulen - 2)))
    return F.when(at > 0, F.concat(masked_user, F.lit("@"), domain)).otherwise(stars(_len(v)))


def mask_name(v: Column) -> Column:
    """K4: strip; one char or less gives ``*``, else the first char + stars."""
    c = strip_ws(v)
    n = _len(c)
    return F.when(n <= 1, F.lit("*")).otherwise(F.concat(_left(c, 1), stars(n - 1)))


def mask_address(v: Column) -> Column:
    """K5: up to 10 chars keep the first half (floor), else keep the first 8."""
    n = _len(v)
    half = F.floor(n / 2).cast("int")
    return F.when(n <= 10, F.concat(F.substr(v, F.lit(1), half), stars(n - half))).otherwise(
        F.concat(_left(v, 8), stars(n - 8))
    )


def mask_generic(v: Column) -> Column:
    """K6: 4 chars or less all stars, else keep 2 + stars + 2."""
    n = _len(v)
    return F.when(n <= 4, stars(n)).otherwise(F.concat(_left(v, 2), stars(n - 4), _right(v, 2)))


PARTIAL = {
    "phone": mask_phone,
    "id_card": mask_id_card,
    "email": mask_email,
    "name": mask_name,
    "address": mask_address,
}


# --- hash, remove (K7, K13) ------------------------------------------------------------

def mask_hash(v: Column, salt: str = "", hash_len: int = 8) -> Column:
    """K7: first ``hash_len`` hex digits of SHA-256 of the UTF-8 text (optionally salted, A8)."""
    base = F.concat(F.lit(salt), v) if salt else v
    return F.substring(F.sha2(base, 256), 1, hash_len)


def mask_remove(v: Column, marker: str = REMOVED_MARKER) -> Column:
    """A constant marker."""
    return F.lit(marker)


# --- keyed random (K8-K12) -------------------------------------------------------------

def _draw(v: Column, seed: int, i: int | Column, n: int) -> Column:
    """A stable draw in [0, n) keyed by the value, the seed and the position ``i``."""
    pos = i if isinstance(i, Column) else F.lit(i)
    return F.pmod(F.xxhash64(v, F.lit(seed), pos), F.lit(n))


def _pick(chars: str, v: Column, seed: int, i: int | Column) -> Column:
    return F.substr(F.lit(chars), _draw(v, seed, i, len(chars)) + 1, F.lit(1))


def _pick_from(values: list[str], v: Column, seed: int, i: int) -> Column:
    arr = F.array(*[F.lit(x) for x in values])
    return F.element_at(arr, (_draw(v, seed, i, len(values)) + 1).cast("int"))


def _digits(v: Column, seed: int, start: int, count: int) -> Column:
    return F.concat(*[_pick(DIGITS, v, seed, start + k) for k in range(count)])


def random_phone(v: Column, seed: int) -> Column:
    """K8: one of the fixed prefixes + 8 digits."""
    return F.concat(_pick_from(PHONE_PREFIXES, v, seed, 0), _digits(v, seed, 1, 8))


def random_id_card(v: Column, seed: int) -> Column:
    """K9: 17 digits + a digit or X."""
    return F.concat(_digits(v, seed, 0, 17), _pick(ID_LAST, v, seed, 17))


def random_email(v: Column, seed: int) -> Column:
    """5-10 lower-case letters @ one of the fixed domains."""
    n = (_draw(v, seed, 0, 6) + 5).cast("int")
    letters = F.concat(*[_pick(LOWER, v, seed, 1 + k) for k in range(10)])
    return F.concat(F.substr(letters, F.lit(1), n), F.lit("@"), _pick_from(EMAIL_DOMAINS, v, seed, 11))


def random_name(v: Column, seed: int) -> Column:
    """A surname + one or two given-name characters."""
    two = _draw(v, seed, 0, 2) == 0
    first = _pick_from(SURNAMES, v, seed, 1)
    g1 = _pick_from(GIVEN_NAMES, v, seed, 2)
    g2 = _pick_from(GIVEN_NAMES, v, seed, 3)
    return F.when(two, F.concat(first, g1)).otherwise(F.concat(first, g1, g2))


def random_text(v: Column, seed: int) -> Column:
    """Random letters and digits, as long as the value (length > 0 by K15)."""
    positions = F.sequence(F.lit(1), F.greatest(F.char_length(v), F.lit(1)))
    # the value is hashed once; as a lambda's variable the hash is not computed again for each character
    text = F.transform(F.array(F.xxhash64(v, F.lit(seed))), lambda h: F.array_join(F.transform(positions, lambda i: _pick(ALPHANUMERIC, h, seed, i)), ""))
    return F.element_at(text, 1)


RANDOM = {
    "phone": random_phone,
    "id_card": random_id_card,
    "email": random_email,
    "name": random_name,
}


# --- dispatch (K14, K15) ---------------------------------------------------------------

def mask(
    v: Column,
    masking_type: str,
    strategy: str = "partial",
    *,
    seed: int | None = None,
    salt: str = "",
    hash_len: int = 8,
    marker: str = REMOVED_MARKER,
) -> Column:
    """The expression for one type and strategy; unknown strategy means partial.

    ``seed`` keys the random masks; without one, another is drawn each time. ``v`` must be text. Null stays null; blank text is returned unchanged (K15).
    """
    if strategy == "hash":
        body = mask_hash(v, salt, hash_len)
    elif strategy == "random":
        body = RANDOM.get(masking_type, random_text)(v, secrets.randbits(62) if seed is None else seed)
    elif strategy == "remove":
        body = mask_remove(v, marker)
    else:
        body = PARTIAL.get(masking_type, mask_generic)(v)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(is_blank(v), v).otherwise(body)


__all__ = [
    "STRATEGIES", "REMOVED_MARKER", "mask", "mask_phone", "mask_id_card", "mask_email", "mask_name",
    "mask_address", "mask_generic", "mask_hash", "mask_remove", "random_phone", "random_id_card",
    "random_email", "random_name", "random_text", "WS",
]
