"""Readings of annotated lines held against another's, and put into the written line.

An annotated line has its runs as ``{base|reading}`` between plain text. Against a line's whole
reading from elsewhere it is a row of literals and gaps: which places the rest of the line can
be read from is found from the end back, then each run takes our own reading if the rest can
follow, else as little as it can. Each row is worked on by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from chronotext.functions import scripts

_RUN = re.compile(r"\{([^|{}]+)\|([^{}]+)\}")
#: Ideographs and the mark that repeats one; what is compared; readings, and a
#: reading in brackets.
IDEOGRAPH = "㐀-鿿々"
COMPARED = re.compile(f"[^ぁ-ゖー{IDEOGRAPH}a-z0-9]")
READING, BRACKETED = re.compile("^[ぁ-ゖー]+$"), "(?:[(（][ぁ-ヿa-zA-Z]+[)）])?"
_SOUNDS = str.maketrans(scripts.KATAKANA, scripts.HIRAGANA)
#: Rows of a batch that are held as Python's values at once.
ROWS = 64
DIFFS = "array<struct<base string, ours string, theirs string, parts array<struct<base string, ours string>>>>"


def squashed(text: str) -> str:
    """Kana as hiragana, ideographs, Latin letters in lower case and digits; nothing else."""
    return COMPARED.sub("", unicodedata.normalize("NFKC", text).translate(_SOUNDS).lower())


def tokens(annotated: str) -> list[str | dict]:
    """Literals and runs in order; runs with nothing read between them are one."""
    out: list[str | dict] = []
    at = 0
    for m in [*_RUN.finditer(annotated), None]:
        literal = squashed(annotated[at : m.start() if m else len(annotated)])
        if literal:
            out.append(literal)
        if m:
            at, part = m.end(), {"base": m[1], "ours": m[2].translate(_SOUNDS)}
            if out and isinstance(out[-1], dict):
                out[-1] = {"base": out[-1]["base"] + part["base"], "ours": out[-1]["ours"] + part["ours"], "parts": [*out[-1]["parts"], part]}
            else:
                out.append(part | {"parts": [part]})
    return out


def differences(annotated: str, theirs: str) -> list[dict] | None:
    """Runs that are read differently elsewhere, (base, ours, theirs, parts); None if the line
    can't be read as theirs at all. Readings that are no plain hiragana are left out."""
    line, n = tokens(annotated), len(theirs)
    follows = np.zeros((len(line) + 1, n + 1), bool)
    follows[-1, n] = True
    for i in range(len(line) - 1, -1, -1):
        own = line[i] if isinstance(line[i], str) else line[i]["ours"]
        starts = np.array([p for p in range(n - len(own) + 1) if theirs.startswith(own, p)], np.int64)
        follows[i, starts] = follows[i + 1, starts + len(own)]
        if not isinstance(line[i], str):
            ends = np.flatnonzero(follows[i + 1])
            follows[i, : ends[-1] if len(ends) else 0] = True
    if not any(isinstance(x, dict) for x in line):
        return []
    if not follows[0, 0]:
        return None
    out, p = [], 0
    for i, x in enumerate(line):
        own = x if isinstance(x, str) else x["ours"]
        q = p + len(own)
        if not (theirs.startswith(own, p) and follows[i + 1, q]):
            q = p + 1 + int(follows[i + 1, p + 1 :].argmax())
        if isinstance(x, dict) and (read := theirs[p:q]) != own and READING.match(read):
            out.append(x | {"theirs": read})
        p = q
    return out


def shared_out(parts: list[dict], theirs: str) -> list[tuple[str, str]]:
    """(base, reading) of the parts of a run that is read as theirs: parts whose own reading
    stands at either end keep it, the rest divide what is left by their numbers of signs. Only
    those whose reading changes."""
    read: list[str | None] = [None] * len(parts)
    rest, first, last = theirs, 0, len(parts) - 1
    while last > first and rest.endswith(parts[last]["ours"]):
        read[last], rest = parts[last]["ours"], rest[: len(rest) - len(parts[last]["ours"])]
        last -= 1
    while first < last and rest.startswith(parts[first]["ours"]):
        read[first], rest = parts[first]["ours"], rest[len(parts[first]["ours"]) :]
        first += 1
    signs, used, seen = sum(len(x["base"]) for x in parts[first : last + 1]), 0, 0
    for k in range(first, last + 1):
        seen += len(parts[k]["base"])
        end = len(rest) if k == last else max(used + 1, (2 * len(rest) * seen + signs) // (2 * signs))
        read[k], used = rest[used:end], end
    return [(x["base"], r) for x, r in zip(parts, read) if r and r != x["ours"]]


def written(line: str, diffs: list[dict]) -> tuple[str, int, int]:
    """(line with readings behind the bases they belong to, number written, number left out).

    Parts that stand next to each other in the line are one again. A reading of more than four
    sounds a sign, and one more, has swallowed a neighbour and is left out, as is one whose base
    doesn't stand by itself or has it already."""
    done = left = 0
    for d in diffs:
        if not d["ours"] or len(d["theirs"]) > 4 * len(d["base"]) + 1:
            left += 1
            continue
        parts: list[dict] = []
        for x in d["parts"]:
            if parts and parts[-1]["base"] + x["base"] in line:
                parts[-1] = {"base": parts[-1]["base"] + x["base"], "ours": parts[-1]["ours"] + x["ours"]}
            else:
                parts.append(dict(base=x["base"], ours=x["ours"]))
        for base, read in shared_out(parts, d["theirs"]) if len(parts) > 1 else [(parts[0]["base"], d["theirs"])]:
            place = re.search(f"(?<![{IDEOGRAPH}]){re.escape(base)}{BRACKETED}(?![{IDEOGRAPH}])", line)
            if place is None or f"{base}({read})" in line:
                left += 1
            else:
                line = f"{line[: place.start()]}{base}({read}){line[place.end() :]}"
                done += 1
    return line, done, left


def columns() -> dict:
    """Column functions: differences(annotated, theirs) and written(line, diffs); a null in
    gives null."""

    diffs = to_arrow_type(DataType.fromDDL(DIFFS))
    put = pa.struct([("line", pa.string()), ("done", pa.int32()), ("left", pa.int32())])

    def by_slices(how, kind: pa.DataType):
        def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for a, b in parts:
                # a batch as Python's values takes far more than in Arrow
                some = (zip(a.slice(k, ROWS).to_pylist(), b.slice(k, ROWS).to_pylist()) for k in range(0, len(a), ROWS))
                yield pa.chunked_array([pa.array([how(x, y) for x, y in rows], kind) for rows in some], kind).combine_chunks()

        return run

    compare = by_slices(lambda x, y: None if x is None or y is None else differences(x, y), diffs)
    write = by_slices(lambda x, y: dict(zip(("line", "done", "left"), (None, None, None) if x is None or y is None else written(x, y))), put)
    return {"differences": F.arrow_udf(compare, DIFFS), "written": F.arrow_udf(write, "line string, done int, left int")}
