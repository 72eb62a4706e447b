"""C source: what is code and what is comment or literal, named definitions, macros."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comments and literals, closed or running to the end of the text.
HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z|\\\Z)|'(?:\\.|[^'\\])*(?:'|\Z|\\\Z)""", re.S)
NAME = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
CONTROL = frozenset(("if", "for", "while", "switch", "return", "sizeof", "do", "else"))


def masked(source: str) -> str:
    """The source with blanks for comments and literals; places and line ends stay."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def pairs(code: str, opening: str, closing: str) -> dict[int, int]:
    """Place of each opening delimiter -> place of its closing one; those without are left out."""
    waiting, out = [], {}
    for m in re.finditer(rf"[{re.escape(opening + closing)}]", code):
        if m[0] == opening:
            waiting.append(m.start())
        elif waiting:
            out[waiting.pop()] = m.start()
    return out


def definitions(source: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of function definitions in order: a name, a parameter list, then a body; declarations and calls are neither."""
    code = masked(source)
    lists, bodies = pairs(code, "(", ")"), pairs(code, "{", "}")
    ends = [m.start() for m in re.finditer(r"[;{}]", code)]
    found, before = [], -1
    at = 0
    for m in NAME.finditer(code):
        close = lists.get(m.end() - 1)
        if close is None or m[1] in CONTROL:
            continue
        body = close + 1 + len(code[close + 1 :]) - len(code[close + 1 :].lstrip()) if code[close + 1 : close + 2].isspace() else close + 1
        if bodies.get(body) is None:
            continue
        while at < len(ends) and ends[at] < m.start():
            before = ends[at]
            at += 1
        start, end = before + 1, bodies[body] + 1
        text = source[start:end]
        found.append((m[1], start + len(text) - len(text.lstrip()), start + len(text.rstrip())))
    return found


def functions(rows: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None) -> DataFrame:
    """id_col, name, nth, text: every definition in each source, the first of a name being nth 1; with `names` (id_col, name), those only.

    Null sources have none; unbalanced ones give what is balanced in them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, source in zip(b.column(0), b.column(1).to_pylist()):
                seen: dict[str, int] = {}
                out = []
                for name, a, z in definitions(source or ""):
                    seen[name] = seen.get(name, 0) + 1
                    out.append((name, seen[name], source[a:z]))
                if out:
                    n, k, t = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(n), b.column(0).type), pa.array(n), pa.array(k, pa.int32()), pa.array(t)], [id_col, "name", "nth", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, name string, nth int, text string")
    return found if names is None else found.join(names.select(id_col, "name").distinct(), [id_col, "name"], "left_semi").select(id_col, "name", "nth", "text")


def macros(rows: DataFrame, id_col: str, text: Column | str) -> DataFrame:
    """id_col, name, definition: each macro definition of a source as one line, continued lines joined and white space evened out."""
    text = F.col(text) if isinstance(text, str) else text
    joined = F.regexp_replace(text, r"\\\r?\n", " ")
    lines = F.transform(F.split(joined, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    directives = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.concat(F.lit("#"), F.ltrim(F.substring(x, 2, 1 << 30))))
    defined = F.filter(directives, lambda x: x.startswith("#define "))
    each = rows.select(id_col, F.explode(defined).alias("definition"))
    name = F.regexp_extract(F.substring("definition", 9, 1 << 30), r"^\w+", 0)
    return each.select(id_col, name.alias("name"), "definition").where(F.col("name").rlike("^[A-Za-z_]"))
