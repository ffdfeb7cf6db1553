"""Porter's stemmer as SQL expressions: for Spark over an array of words, for DuckDB as a chain of tables.

A step is one ``transform``, so its word is a variable of the lambda and no step's expression is written out
inside the next one. Words of fewer than three letters stay as they are. A step's own text is the same for both
engines but for the name of the regular expressions' test.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of Porter's steps 2, 3 and 4 and what stands for them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = {"al": "", "ance": "", "ence": "", "er": "", "ic": "", "able": "", "ible": "", "ant": "", "ement": "", "ment": "", "ent": "", "sion": "s", "tion": "t", "ou": "", "ism": "", "ate": "", "iti": "", "ous": "", "ive": "", "ize": ""}

#: What a stem has: one or two changes from vowels to consonants, a vowel, an ending like -hop. Y is a y that is a consonant.
ONE, TWO = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
VOWEL, SHORT = "[aeiouy]", "[^aeiouy][aeiouy][^aeiouywxY]$"


@cache
def steps(duckdb: bool = False) -> tuple[str, ...]:
    """The steps as expressions of ``w``."""
    every = ", 'g'" if duckdb else ""
    group = "\\1" if duckdb else "$1"
    test = (lambda x, p: f"regexp_matches({x}, '{p}')") if duckdb else (lambda x, p: f"{x} RLIKE '{p}'")
    cut = lambda n: f"left(w, length(w) - {n})"
    case = lambda *parts: f"CASE {' '.join(f'WHEN {a} THEN {b}' for a, b in parts)} ELSE w END"
    ends = lambda s: f"w LIKE '%{s}'"

    def table(suffixes: dict[str, str], measure: str) -> str:
        """The longest suffix that fits is replaced if what is before it (with the s or t of -sion, -tion) has the measure."""
        parts = []
        for s in sorted(suffixes, key=lambda s: (-len(s), s)):
            rest = cut(len(s) - 1 if suffixes[s] in ("s", "t") else len(s))
            parts.append((ends(s), f"CASE WHEN {test(rest, measure)} THEN concat({cut(len(s))}, '{suffixes[s]}') ELSE w END"))
        return case(*parts)

    off = lambda n: f"CASE WHEN {test(cut(n), VOWEL)} THEN concat({cut(n)}, '+') ELSE w END"  # noqa: E731  a plus where the end is to be mended
    doubled = f"left(right(w, 2), 1) = left(right(w, 3), 1) AND length(w) > 2 AND {test(cut(1), '[^aeiouylsz]$')}"
    short = lambda n: f"{test(cut(n), ONE)} AND NOT {test(cut(n), TWO)} AND {test(cut(n), SHORT)}"
    return (
        f"regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '{group}Y'{every})",
        case((f"NOT {ends('s')} OR {ends('ss')} AND NOT {ends('sses')}", "w"), (f"{ends('sses')} OR {ends('ies')}", cut(2)), (ends("s"), cut(1))),
        case((ends("eed"), f"CASE WHEN {test(cut(3), ONE)} THEN {cut(1)} ELSE w END"), (ends("ed"), off(2)), (ends("ing"), off(3))),
        case((f"NOT {ends('+')}", "w"), (f"{ends('at+')} OR {ends('bl+')} OR {ends('iz+')}", f"concat({cut(1)}, 'e')"), (doubled, cut(2)), (short(1), f"concat({cut(1)}, 'e')"), ("true", cut(1))),
        case((f"{test('w', '[yY]$')} AND {test(cut(1), VOWEL)}", f"concat({cut(1)}, 'i')")),
        table(STEP2, ONE), table(STEP3, ONE), table(STEP4, TWO),
        case((f"{ends('e')} AND ({test(cut(1), TWO)} OR {test(cut(1), ONE)} AND NOT {test(cut(1), SHORT)})", cut(1))),
        f"replace({case((f'{ends("ll")} AND {test(cut(1), TWO)}', cut(1)))}, 'Y', 'y')",
    )


def stems(words: str) -> Column:
    """The stems of a column that is an array of lower-case words."""
    out = f"`{words}`"
    for step in steps():
        out = f"transform({out}, w -> {step})"
    return F.expr(f"zip_with(`{words}`, {out}, (x, s) -> if(length(x) < 3, x, s))")


def stem_ctes(source: str) -> str:
    """``stems`` (word, stem) of the distinct words of ``source`` (word), as common table expressions for DuckDB."""
    out, last = [f"stem_0 AS (SELECT DISTINCT word, word AS w FROM {source} WHERE length(word) > 2)"], 0
    for last, s in enumerate(steps(duckdb=True), 1):
        out.append(f"stem_{last} AS (SELECT word, {s} AS w FROM stem_{last - 1})")
    out.append(f"stems AS (SELECT word, w AS stem FROM stem_{last} UNION ALL SELECT DISTINCT word, word FROM {source} WHERE length(word) < 3)")
    return ",\n".join(out)
