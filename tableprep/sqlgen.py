"""DuckDB SQL text for the oracle side of the query registry.

These are independent re-statements of each rule in plain SQL (RE2 regular expressions,
DuckDB string functions), used only to check the Spark results.
"""

from __future__ import annotations

# Java's (?U)\s as an explicit RE2 class (RE2's \s is ASCII and lacks \v).
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUMBER_RE = r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, '{WS}*')"


def stars(n: str) -> str:
    return f"repeat('*', CAST({n} AS BIGINT))"


def guard(x: str, body: str) -> str:
    """Null stays null, blank stays as is."""
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {blank(x)} THEN {x} ELSE {body} END"


def phone_clean(x: str) -> str:
    return f"regexp_replace({x}, '({WS}|[\\-\\(\\)\\+])', '', 'g')"


def mask_phone(x: str) -> str:
    c = phone_clean(x)
    return guard(x, f"CASE WHEN length({c}) >= 11 THEN substr({c}, 1, 3) || '****' || right({c}, 4) ELSE {stars(f'length({c})')} END")


def mask_id_card(x: str) -> str:
    c = f"replace({x}, ' ', '')"
    return guard(x, f"CASE WHEN length({c}) >= 18 THEN substr({c}, 1, 6) || '********' || right({c}, 4) "
                    f"WHEN length({c}) >= 15 THEN substr({c}, 1, 6) || '*****' || right({c}, 4) ELSE {stars(f'length({c})')} END")


def mask_email(x: str) -> str:
    at = f"strpos({x}, '@')"
    user = f"substr({x}, 1, {at} - 1)"
    dom = f"substr({x}, {at} + 1)"
    mu = f"CASE WHEN length({user}) <= 2 THEN {stars(f'length({user})')} ELSE substr({user}, 1, 2) || {stars(f'length({user}) - 2')} END"
    return guard(x, f"CASE WHEN {at} > 0 THEN {mu} || '@' || {dom} ELSE {stars(f'length({x})')} END")


def mask_name(x: str) -> str:
    c = strip(x)
    return guard(x, f"CASE WHEN length({c}) <= 1 THEN '*' ELSE substr({c}, 1, 1) || {stars(f'length({c}) - 1')} END")


def mask_address(x: str) -> str:
    n = f"length({x})"
    return guard(x, f"CASE WHEN {n} <= 10 THEN substr({x}, 1, {n} // 2) || {stars(f'{n} - {n} // 2')} "
                    f"ELSE substr({x}, 1, 8) || {stars(f'{n} - 8')} END")


def mask_generic(x: str) -> str:
    n = f"length({x})"
    return guard(x, f"CASE WHEN {n} <= 4 THEN {stars(n)} ELSE substr({x}, 1, 2) || {stars(f'{n} - 4')} || right({x}, 2) END")


def mask_hash(x: str) -> str:
    return guard(x, f"substr(sha256({x}), 1, 8)")


def mask_remove(x: str) -> str:
    return guard(x, "'[已删除]'")


PARTIAL = {"phone": mask_phone, "id_card": mask_id_card, "email": mask_email, "name": mask_name,
           "address": mask_address, "text": mask_generic}


def is_phone(x: str) -> str:
    nosep = f"replace(replace({x}, ' ', ''), '-', '')"
    return (f"coalesce({x} <> '' AND (regexp_full_match({phone_clean(x)}, '[0-9]{{10,15}}') "
            f"OR regexp_matches({nosep}, '[0-9]{{7,15}}x[0-9]+')), false)")


def is_id_card(x: str) -> str:
    c = f"upper(replace({x}, ' ', ''))"
    return (f"coalesce({x} <> '' AND ((length({c}) = 18 AND regexp_full_match({c}, '[0-9]{{17}}[0-9X]')) "
            f"OR (length({c}) = 15 AND regexp_full_match({c}, '[0-9]{{15}}'))), false)")


def is_email(x: str) -> str:
    return f"coalesce({x} <> '' AND regexp_full_match({x}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), false)"


def is_cn_name(x: str) -> str:
    return f"coalesce({x} <> '' AND regexp_full_match({strip(x)}, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}'), false)"


def is_address(x: str) -> str:
    return f"coalesce(length({x}) > 5, false)"


PREDICATES = {"phone": is_phone, "id_card": is_id_card, "email": is_email, "name": is_cn_name, "address": is_address}


def word_count(x: str) -> str:
    s = strip(x)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN CAST(0 AS BIGINT) "
            f"ELSE CAST(len(regexp_split_to_array({s}, '{WS}+')) AS BIGINT) END")


def is_empty(x: str) -> str:
    return f"CAST({blank(x)} AS INTEGER)"


def first_values(table: str, key: str, cols: list[tuple[str, str]], n: int) -> str:
    """(column, pos, value) of the first n non-null text values per column; cols = (name, text expr)."""
    parts = " UNION ALL ".join(
        f"SELECT {key} AS k, {lit(c)} AS column, {e} AS value FROM {table}" for c, e in cols)
    return (f"SELECT column, pos, value FROM (SELECT column, value, row_number() OVER (PARTITION BY column ORDER BY k) AS pos "
            f"FROM ({parts}) u WHERE value IS NOT NULL) s WHERE pos <= {n}")
