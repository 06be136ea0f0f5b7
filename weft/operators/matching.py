"""Row patterns: MATCH_RECOGNIZE over ordered partitions.

A row gets the letters of the symbols whose conditions it meets; the pattern is run over them with backtracking, quantifiers,
alternation and permutation. Exclusion, {- -}, only groups: all rows of matches with it are refused. Conditions are columns and may look back and ahead with prev and next. Each
partition is one group of rows, as the clause defines it.
"""

from __future__ import annotations

import re
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prev(column: str, n: int = 1) -> tuple:
    return ("lag", column, n)


def next_(column: str, n: int = 1) -> tuple:
    return ("lead", column, n)


def shifted(df: DataFrame, partition: list[str], order: list[str], shifts: dict[str, tuple]) -> DataFrame:
    """Adds PREV and NEXT columns that conditions use."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({n: getattr(F, f)(c, k).over(w) for n, (f, c, k) in shifts.items()})


def compiled(pattern: str, symbols: dict[str, str]) -> str:
    """A pattern of symbols as a regular expression over rows: a row is its letters between commas."""

    def permute(m: re.Match) -> str:
        names = [n.strip() for n in m[1].split(",")]
        return "(?:" + "|".join(" ".join(p) for p in permutations(names)) + ")"

    pattern = re.sub(r"PERMUTE\s*\(([^)]*)\)", permute, pattern)
    pattern = re.sub(r"\{-(.*?)-\}", r"(?:\1)", pattern)
    out = re.sub(r"[A-Za-z_]\w*", lambda m: f"(?:[^,]*{symbols[m[0]]}[^,]*,)" if m[0] in symbols else m[0], pattern)
    return out.replace(" ", "")


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, measures: dict[str, tuple], schema: str, all_rows: bool = False, skip: str = "PAST LAST ROW") -> DataFrame:
    """measures: output -> (FIRST or LAST, column), (COUNT, None), (MATCH_NUMBER, None) or (CLASSIFIER, None). Gives one row
    a match with the partition's columns, or all rows of matches. CLASSIFIER is the first symbol that the row meets."""
    if all_rows and "{-" in pattern:
        raise NotImplementedError("all rows of a pattern with exclusion")
    letters = {s: chr(ord("a") + i) for i, s in enumerate(define)}
    marks = F.concat(*[F.when(F.coalesce(c, F.lit(False)), letters[s]).otherwise("") for s, c in define.items()], F.lit(","))
    regex = re.compile(compiled(pattern, letters))
    names = {v: k for k, v in letters.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        text = "".join(pdf["_marks"])
        starts = [0]
        for m in pdf["_marks"]:
            starts.append(starts[-1] + len(m))
        row_at = {s: i for i, s in enumerate(starts)}
        out, at, number = [], 0, 0
        while at < len(pdf):
            m = regex.match(text, starts[at])
            if not m or m.end() == m.start():
                at += 1
                continue
            a, b = at, row_at[m.end()]
            number += 1
            for i in range(a, b) if all_rows else [b - 1]:
                row = {c: pdf.at[i, c] for c in (pdf.columns if all_rows else partition) if c != "_marks"}
                for name, (f, c) in measures.items():
                    row[name] = {"FIRST": lambda: pdf.at[a, c], "LAST": lambda: pdf.at[i, c], "COUNT": lambda: i - a + 1, "MATCH_NUMBER": lambda: number, "CLASSIFIER": lambda: names.get(pdf.at[i, "_marks"][:1])}[f]()  # noqa: B023
                out.append(row)
            at = a + 1 if skip == "TO NEXT ROW" else b
        wanted = [f.split()[0] for f in schema.split(", ")]
        return pd.DataFrame(out, columns=wanted)

    return df.withColumn("_marks", marks).groupBy(*partition).applyInPandas(run, schema)
