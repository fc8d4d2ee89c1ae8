"""Column expressions on texts: search terms, patterns, cuts and previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accents that search folds: letter by letter.
_ACCENTED, _PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

# Bytes of a chunk preview, and what marks a shortened one.
PREVIEW_BYTES = 1200
PREVIEW_MARK = "\n... [truncated; source is read from filesystem by line range]"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """Search terms: runs of letters and digits, lower-cased, accents folded."""
    plain = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold_terms(text: str) -> list[str]:
    """``tokens`` for a query on the driver."""
    plain = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    return [t for t in re.split(r"[\W_]+", plain) if t]


def like_literal(query: str) -> str:
    """A LIKE pattern around user input: its % and _ stay wildcards, its backslashes are literal."""
    return "%" + query.replace("\\", "\\\\") + "%"


def like_ignoring_ascii_case(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))


def lines(c: Column) -> Column:
    """The lines of a text without their ends; no line follows a final line end."""
    body = F.regexp_replace(c, r"\n\z", "")
    cut = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(cut)


def cut_bytes(c: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, never part of a character."""
    raw = c.cast("binary")

    def starts_char(at: int) -> Column:
        head = F.hex(F.substring(raw, at, 1))
        return ~F.substring(head, 1, 1).isin("8", "9", "A", "B")

    kept = F.lit(most)
    for back in (3, 2, 1, 0):
        kept = F.when(starts_char(most + 1 - back), F.lit(most - back)).otherwise(kept) if back else F.when(starts_char(most + 1), F.lit(most)).otherwise(kept)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), kept.cast("int")), "UTF-8"))


def preview(c: Column) -> Column:
    """What the store keeps of a chunk for quick display."""
    most = PREVIEW_BYTES + len(PREVIEW_MARK.encode())
    short = F.concat(F.rtrim(F.regexp_replace(cut_bytes(c, PREVIEW_BYTES), r"\s+\z", "")), F.lit(PREVIEW_MARK))
    return F.when(F.octet_length(c) <= most, c).otherwise(short)


def shorten(c: Column, most: int) -> Column:
    """At most so many characters, the last three dots if anything is lost."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(c)


def shorten_text(text: str, most: int) -> str:
    """``shorten`` on the driver."""
    return text if len(text) <= most else text[: max(most - 3, 0)] + "..."


def glob_regex(pattern: str) -> str:
    """An anchored Java regular expression for a glob; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            if pattern[i - 1 : i + 2] == "**/" and (i < 2 or pattern[i - 2] == "/"):
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            close = pattern.find("]", i + 2)
            if close < 0:
                raise ValueError(f"unclosed [ in glob {pattern!r}")
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", "\\[") + "]")
            i = close
        elif ch == "{":
            out.append("(?:")
        elif ch == "}":
            out.append(")")
        elif ch == "," and out.count("(?:") > out.count(")"):
            out.append("|")
        else:
            out.append(re.sub(r"([\\.^$|()+*?{}\[\]])", r"\\\1", ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def check_regex(pattern: str) -> str:
    """Reject look-around and back-references, which linear-time engines do not offer."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    return pattern


def callee_parts(c: Column) -> Column:
    """name and qualifier of a callee text: its last and second-last part between dots and colons.

    Parts lose everything but letters, digits and _ at their ends; empty parts do not count; a name
    of digits alone is no name.
    """
    parts = F.filter(F.transform(F.split(c, "[.:]"), lambda p: F.regexp_replace(p, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), lambda p: p != "")
    name = F.try_element_at(parts, F.lit(-1))
    ok = name.isNotNull() & ~name.rlike("^[0-9]+$")
    return F.struct(F.when(ok, name).alias("name"), F.when(ok, F.try_element_at(parts, F.lit(-2))).alias("qualifier"))
