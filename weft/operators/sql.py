"""SQL of the reference dialect on Spark SQL: what Spark doesn't read is written anew before it is parsed.

Covered: JDBC escapes {fn f(x)}, {d '…'}, {t '…'}, {ts '…'}; comparisons with SOME, ANY and ALL of a sub-query; OFFSET … ROWS FETCH
NEXT … ROWS ONLY; TUMBLE, HOP and SESSION with their START and END; TABLESAMPLE BERNOULLI and SYSTEM; BETWEEN SYMMETRIC;
SIMILAR TO a literal; IS [NOT] JSON; MEMBER OF, IS A SET and IS EMPTY; MULTISET UNION, EXCEPT and INTERSECT [DISTINCT];
OVERLAPS and the other period predicates; SELECT STREAM; CROSS and OUTER APPLY; SYSTEM_USER, CURRENT_ROLE and CURRENT_PATH (the
last two are empty texts); EXPLAIN PLAN FOR. GROUP_ID() is left to the builder.

Nulls sort high where the text doesn't say otherwise, also in windows; a division by zero gives null. Text between quotes and
comments are set apart before anything is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.functions.scalar import _ESCAPES, similar_pattern

_FIELD = r"([\w.`]+(?:\([^()]*\))?)"  # a name or a simple call
_VALUE = r"('[^']*'|[\w.`]+(?:\([^()]*\))?)"


def _closing(text: str, at: int) -> int:
    """Place after the bracket that closes the one at a place."""
    depth, quoted = 0, False
    for i in range(at, len(text)):
        ch = text[i]
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if not depth:
                return i + 1
    raise ValueError("a bracket is open")


def _escapes(text: str) -> str:
    def call(m: re.Match) -> str:
        name = m[1].upper()
        if name == "TRUNCATE":
            return f"(signum({m[2]}) * floor(abs({m[2]})))"
        if name in ("TIMESTAMPADD", "TIMESTAMPDIFF"):
            return f"{name}({re.sub(r'SQL_TSI_', '', m[2], flags=re.I)})"
        return f"{_ESCAPES[name]}({m[2]})"

    text = re.sub(r"\{\s*d\s+('[^']*')\s*\}", r"DATE \1", text, flags=re.I)
    text = re.sub(r"\{\s*ts\s+('[^']*')\s*\}", r"TIMESTAMP \1", text, flags=re.I)
    text = re.sub(r"\{\s*t\s+('[^']*')\s*\}", r"TIME \1", text, flags=re.I)
    while True:
        new = re.sub(r"\{\s*fn\s+(\w+)\s*\(([^{}]*)\)\s*\}", call, text, flags=re.I)
        if new == text:
            return text
        text = new


_EXTREME = {("<", "SOME"): "max", ("<=", "SOME"): "max", (">", "SOME"): "min", (">=", "SOME"): "min", ("<", "ALL"): "min", ("<=", "ALL"): "min", (">", "ALL"): "max", (">=", "ALL"): "max"}


def _quantified(text: str) -> str:
    """x < SOME (q) compares with the greatest of q, x < ALL (q) with the least. Of no rows SOME is false and ALL true; where
    the values decide nothing, a null among them makes the answer unknown."""
    pattern = re.compile(rf"{_FIELD}\s*(<=|>=|<>|=|<|>)\s*(SOME|ANY|ALL)\s*\(", re.I)
    while m := pattern.search(text):
        end = _closing(text, m.end() - 1)
        x, op, how, query = m[1], m[2], "ALL" if m[3].upper() == "ALL" else "SOME", text[m.end() : end - 1]
        of = lambda e: f"(SELECT {e} FROM ({query}) AS q_(v_))"  # noqa: B023, E731
        if (op, how) == ("=", "SOME"):
            new = f"{x} IN ({query})"
        elif (op, how) == ("<>", "ALL"):
            new = f"{x} NOT IN ({query})"
        else:
            if op in ("=", "<>"):
                holds = f"({x} {op} {of('min(v_)')} {'AND' if op == '=' else 'OR'} {x} {op} {of('max(v_)')})"
            else:
                holds = f"{x} {op} {of(_EXTREME[op, how] + '(v_)')}"
            none, decided = ("true", "NOT ") if how == "ALL" else ("false", "")
            new = f"CASE WHEN {of('count(*) = 0')} THEN {none} WHEN {decided}{holds} THEN {'false' if how == 'ALL' else 'true'} WHEN {of('count(v_) < count(*)')} THEN NULL ELSE {holds} END"
        text = text[: m.start()] + new + text[end:]
    return text


_AFTER_ORDER = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "FOR", "CLUSTER", "DISTRIBUTE", "SORT"}


def _nulls_high(text: str) -> str:
    """Says where nulls stand in each ORDER BY that doesn't."""
    out, at = [], 0
    for m in re.finditer(r"\bORDER\s+BY\b", text, re.I):
        if re.search(r"WITHIN\s+GROUP\s*\(\s*$", text[: m.start()], re.I):
            continue
        depth, start, ends = 0, m.end(), []
        stop = len(text)
        for t in re.finditer(r"'[^']*'|`[^`]*`|\w+|\S", text[m.end() :]):
            place, word = m.end() + t.start(), t[0].upper()
            depth += (word in "([" and len(word) == 1) - (word in ")]" and len(word) == 1)
            if depth < 0 or depth == 0 and (word in _AFTER_ORDER or word == ";"):
                stop = place
                break
            if depth == 0 and word == ",":
                ends.append(place)
        for end in [*ends, stop]:
            item = text[start:end].rstrip()
            if not re.search(r"\bNULLS\s+(FIRST|LAST)$", item, re.I) and item.strip().upper() != "ALL":
                place = start + len(item)
                out.append((place, " NULLS FIRST" if re.search(r"\bDESC$", item, re.I) else " NULLS LAST"))
            start = end + 1
    for place, words in sorted(out, reverse=True):
        text = text[:place] + words + text[place:]
    return text


_NUMBER = re.compile(r"\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+")
_OPERAND = re.compile(r"[A-Za-z_`][\w.`]*")


def _divided(text: str) -> str:
    """A divisor of zero becomes null."""
    out, at = [], 0
    while m := re.compile(r"[/%]\s*").search(text, at):
        out.append(text[at : m.end()])
        at = m.end()
        if _NUMBER.match(text, at) or text[at : at + 1] in "+-'":
            continue
        name = _OPERAND.match(text, at)
        end = name.end() if name else at
        if name and name[0].upper() in ("CASE", "INTERVAL", "DATE", "TIMESTAMP"):
            continue
        while text[end : end + 1] in ("(", "["):
            end = _closing(text, end) if text[end] == "(" else text.index("]", end) + 1
        if end > at:
            out.append(f"nullif({_divided(text[at:end])}, 0)")
            at = end
    return "".join([*out, text[at:]])


def _applied(text: str) -> str:
    """CROSS and OUTER APPLY of a sub-query."""
    text = re.sub(r"\bCROSS\s+APPLY\b", "CROSS JOIN LATERAL", text, flags=re.I)
    while m := re.search(r"\bOUTER\s+APPLY\s*(?=\()", text, re.I):
        end = _closing(text, m.end())
        alias = re.compile(r"\s*(?:AS\s+)?\w+(?:\s*\([^()]*\))?", re.I).match(text, end)
        text = f"{text[: m.start()]}LEFT JOIN LATERAL {text[m.end() : alias.end()]} ON true{text[alias.end() :]}"
    return text


def _windows(text: str) -> str:
    def length(interval: str) -> str:
        n, unit = re.match(r"INTERVAL\s+'?(\d+)'?\s+(\w+)", interval.strip(), re.I).groups()
        return f"'{n} {unit.lower()}'"

    def call(m: re.Match) -> str:
        kind, part, args = m[1].upper(), (m[2] or "").upper().lstrip("_"), [a.strip() for a in m[3].split(",")]
        if kind == "SESSION":
            w = f"session_window({args[0]}, {length(args[1])})"
        elif kind == "HOP":
            w = f"window({args[0]}, {length(args[2])}, {length(args[1])})"
        else:
            w = f"window({args[0]}, {length(args[1])})"
        return f"{w}.{part.lower()}" if part else w

    return re.sub(r"\b(TUMBLE|HOP|SESSION)(_START|_END)?\s*\(([^()]*)\)", call, text, flags=re.I)


def _periods(text: str) -> str:
    point = r"\(\s*([^(),]+|[\w.]+\([^()]*\))\s*,\s*([^(),]+|[\w.]+\([^()]*\))\s*\)"
    rules = {
        "OVERLAPS": "(greatest({a}, {b}) >= least({c}, {d}) AND greatest({c}, {d}) >= least({a}, {b}))",
        "CONTAINS": "(least({a}, {b}) <= least({c}, {d}) AND greatest({a}, {b}) >= greatest({c}, {d}))",
        "IMMEDIATELY PRECEDES": "(greatest({a}, {b}) = least({c}, {d}))",
        "IMMEDIATELY SUCCEEDS": "(least({a}, {b}) = greatest({c}, {d}))",
        "PRECEDES": "(greatest({a}, {b}) <= least({c}, {d}))",
        "SUCCEEDS": "(least({a}, {b}) >= greatest({c}, {d}))",
        "EQUALS": "(least({a}, {b}) = least({c}, {d}) AND greatest({a}, {b}) = greatest({c}, {d}))",
    }
    for name, rule in rules.items():
        text = re.sub(rf"{point}\s+{name}\s+{point}", lambda m, r=rule: r.format(a=m[1], b=m[2], c=m[3], d=m[4]), text, flags=re.I)
    return text


def _json(text: str) -> str:
    def test(m: re.Match) -> str:
        kind = (m[3] or "VALUE").upper()
        v = f"schema_of_variant(try_parse_json({m[1]}))"
        found = {"VALUE": f"try_parse_json({m[1]}) IS NOT NULL", "OBJECT": f"coalesce({v} LIKE 'OBJECT%', false)", "ARRAY": f"coalesce({v} LIKE 'ARRAY%', false)", "SCALAR": f"coalesce({v} NOT LIKE 'OBJECT%' AND {v} NOT LIKE 'ARRAY%', false)"}[kind]
        return f"({'NOT ' if m[2] else ''}({found}))"

    return re.sub(rf"{_VALUE}\s+IS\s+(NOT\s+)?JSON(?:\s+(VALUE|OBJECT|ARRAY|SCALAR))?\b", test, text, flags=re.I)


def _multisets(text: str) -> str:
    seen = "size(filter(slice({0}, 1, i_ + 1), y_ -> y_ <=> x_)) {1} size(filter({2}, y_ -> y_ <=> x_))"
    for name, rule in {
        "UNION DISTINCT": "array_union({0}, {2})", "EXCEPT DISTINCT": "array_except({0}, {2})", "INTERSECT DISTINCT": "array_intersect({0}, {2})",
        "UNION(?: ALL)?": "concat({0}, {2})", "EXCEPT(?: ALL)?": "filter({0}, (x_, i_) -> " + seen.replace("{1}", ">") + ")", "INTERSECT(?: ALL)?": "filter({0}, (x_, i_) -> " + seen.replace("{1}", "<=") + ")",
    }.items():
        text = re.sub(rf"{_FIELD}\s+MULTISET\s+{name}\s+{_FIELD}", lambda m, r=rule: r.format(m[1], "", m[2]), text, flags=re.I)
    text = re.sub(rf"{_VALUE}\s+(NOT\s+)?MEMBER\s+OF\s+{_FIELD}", lambda m: f"{m[2] or ''}array_contains({m[3]}, {m[1]})", text, flags=re.I)
    text = re.sub(rf"{_FIELD}\s+IS\s+(NOT\s+)?A\s+SET\b", lambda m: f"(size(array_distinct({m[1]})) {'<>' if m[2] else '='} size({m[1]}))", text, flags=re.I)
    return re.sub(rf"{_FIELD}\s+IS\s+(NOT\s+)?EMPTY\b", lambda m: f"(size({m[1]}) {'>' if m[2] else '='} 0)", text, flags=re.I)


def translated(text: str) -> str:
    """The text as Spark reads it. Quoted text is kept apart, so nothing in it is taken for syntax."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        if m[0][0] in "-/":
            return " "
        if re.fullmatch(r"'[\d.]+'", m[0]):
            return m[0]
        held.append(m[0])
        return f"'\x00{len(held) - 1}\x00'"

    text = re.sub(r"--[^\n]*|/\*.*?\*/|\b[rRxX]?'(?:[^']|'')*'|'(?:[^']|'')*'|\"[^\"]*\"", keep, text, flags=re.S)
    text = _escapes(text)
    inside = lambda n: held[int(n)][1:-1]
    text = re.sub(rf"{_FIELD}\s+(NOT\s+)?SIMILAR\s+TO\s+'\x00(\d+)\x00'", lambda m: f"{m[2] or ''}{m[1]} RLIKE {keep(re.match('.*', 'r' + chr(39) + similar_pattern(inside(m[3])) + chr(39), re.S))}", text, flags=re.I)
    text = re.sub(r"\bSELECT\s+STREAM\b", "SELECT", text, flags=re.I)
    text = re.sub(r"\bEXPLAIN\s+PLAN\s+FOR\b", "EXPLAIN", text, flags=re.I)
    text = re.sub(r"\bSYSTEM_USER\b(?!\s*\()", "current_user()", text, flags=re.I)
    text = re.sub(r"\bCURRENT_(?:ROLE|PATH)\b(?!\s*\()", "''", text, flags=re.I)
    text = _windows(_quantified(_applied(_periods(_json(_multisets(text))))))
    text = re.sub(rf"{_FIELD}\s+(NOT\s+)?BETWEEN\s+SYMMETRIC\s+{_VALUE}\s+AND\s+{_VALUE}", lambda m: f"{m[1]} {m[2] or ''}BETWEEN least({m[3]}, {m[4]}) AND greatest({m[3]}, {m[4]})", text, flags=re.I)
    text = re.sub(r"\bTABLESAMPLE\s+(?:BERNOULLI|SYSTEM)\s*\(\s*([\d.]+)\s*\)", r"TABLESAMPLE (\1 PERCENT)", text, flags=re.I)
    text = re.sub(r"\bOFFSET\s+(\d+)\s+ROWS?\s+FETCH\s+(?:NEXT|FIRST)\s+(\d+)\s+ROWS?\s+ONLY\b", r"LIMIT \2 OFFSET \1", text, flags=re.I)
    text = re.sub(r"\bFETCH\s+(?:NEXT|FIRST)\s+(\d+)\s+ROWS?\s+ONLY\b", r"LIMIT \1", text, flags=re.I)
    text = re.sub(r"\bOFFSET\s+(\d+)\s+ROWS?\b", r"OFFSET \1", text, flags=re.I)
    text = _nulls_high(_divided(text))
    return re.sub("'\x00(\\d+)\x00'", lambda m: held[int(m[1])], text)


def run(spark: SparkSession, text: str, tables: Callable[[str], DataFrame] | None = None, names: list[str] = ()) -> DataFrame:
    """The result of a query; names are registered as views over tables first."""
    for name in names:
        tables(name).createOrReplaceTempView(name)
    return spark.sql(translated(text))
