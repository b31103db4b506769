"""Text expressions: ordered regex cascade, name normaliser, label helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions import rules as R
from lineloom.functions.arrays import let
from lineloom.functions.scalars import SEPARATORS, _c


def _q(text: str) -> str:
    """Raw SQL string literal."""
    quote = '"' if "'" in text else "'"
    return f"r{quote}{text}{quote}"


def _fill(template: str, group: str) -> str:
    """Result text with ``{1}``, ``{n}`` and the two fraction forms replaced; NULL where a number is too long."""
    number = f"try_cast({group} AS decimal(38, 0))"  # NULL for over 38 digits: the rule then yields nothing
    slots = {
        "{1}": group,
        "{n}": f"cast({number} AS string)",
        "{fraction_mm}": f"cast({number} * CASE length({group}) WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1 END AS string)",
        "{fraction_cm}": f"cast({number} * CASE length({group}) WHEN 1 THEN 10 ELSE 1 END AS string)",
    }
    pieces = [slots.get(p, _q(p)) for p in re.split(r"(\{\w+\})", template) if p]
    return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def _rule(rule: tuple) -> str:
    """One rule as a CASE over the texts ``s.raw``, ``s.text`` and ``s.raw_trimmed``."""
    pattern, result = rule[0], rule[1]
    opt = rule[2] if len(rule) > 2 else {}
    text = f"s.{opt.get('src', 'text')}"
    hit = [f"regexp_like({text}, {_q('(?i)' + pattern)})"]
    group = f"regexp_extract({text}, {_q('(?i)' + pattern)}, 1)"
    if "first_of" in opt:  # the first looser match must carry the group
        group = f"regexp_extract({text}, {_q('(?i)' + opt['first_of'])}, 1)"
        hit = [f"{group} <> ''"]
    if "unless" in opt:
        hit.append(f"NOT regexp_like(s.{opt.get('unless_src', 'text')}, {_q('(?i)' + opt['unless'])})")
    if "not_after" in opt:
        lead = f"(?i)(.{{0,{opt['not_after_chars']}}}?){pattern}"
        banned = ", ".join(_q(x) for x in opt["not_after"])
        hit.append(f"upper(trim(regexp_extract({text}, {_q(lead)}, 1))) NOT IN ({banned})")
    test = " AND ".join(hit)
    if "cases" not in opt:
        return f"CASE WHEN {test} THEN {_fill(result, group)} END"
    arms = " ".join(f"WHEN {test} AND try_cast({group} AS decimal(38, 0)) BETWEEN {lo} AND {hi} THEN {_fill(template, group)}"
                    for lo, hi, template in opt["cases"])
    return f"CASE {arms} END"


def regex_cascade(col: str, rule_table: list[tuple]) -> Column:
    """First rule that yields a value, NULL when none does. Run it on distinct values.

    The lambda keeps the long rule chain out of generated code, which would exceed the JVM's method
    size, and cleans the text once.
    """
    sources = (f"struct(`{col}` AS raw, regexp_replace(`{col}`, {_q(SEPARATORS)}, ' ') AS text, trim(`{col}`) AS raw_trimmed)")
    chain = ", ".join(_rule(r) for r in rule_table)
    return F.expr(f"transform(array({sources}), s -> coalesce({chain}))[0]")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def fill_from_map(target, key, pairs: dict) -> Column:
    """Target where present, else the value implied by the key."""
    known = {k: v for k, v in pairs.items() if v is not None}
    return F.coalesce(_c(target), F.try_element_at(literal_map(known), _c(key)))


def match_confidence(telescope, spectrograph, detector, sure: list[str]) -> Column:
    parts = [_c(x) for x in (telescope, spectrograph, detector)]
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    one = F.when(F.coalesce(parts[1].isin(sure), F.lit(False)), "high").otherwise("medium")
    return F.when(n >= 2, "high").when(n == 1, one).otherwise("low")


def join_parts(*cols, sep: str = "+") -> Column:
    return F.nullif(F.concat_ws(sep, *[_c(c) for c in cols]), F.lit(""))


def normalize_name(col) -> Column:
    """Canonical spelling of an object name (eight ordered rewrites)."""
    greek = literal_map({k: v for k, v in R.GREEK.items() if k != v})

    def shorten(s: Column) -> Column:
        first = F.substring_index(s, " ", 1)
        short = F.try_element_at(greek, first)
        return F.when(F.contains(s, F.lit(" ")) & short.isNotNull(), F.concat(short, F.substr(s, F.length(first) + 1))).otherwise(s)

    s = let(F.upper(F.trim(F.regexp_replace(F.trim(_c(col)), r"[\s_\-]+", " "))), shorten)
    for pattern, to in R.NAME_REWRITES:
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def first_pattern(col, patterns: list[str]) -> Column:
    """First listed pattern contained in the lower-cased text, NULL when there is none."""
    low = F.lower(_c(col))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in patterns])
