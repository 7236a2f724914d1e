"""SQL text for the expressions that the scorers are made of, in Spark's dialect or DuckDB's.

The scorers are declared once, as SQL over a text expression; Spark runs them as native expressions (no Python), and
the same declaration gives the SQL that another engine is asked for the same rows.
"""

from __future__ import annotations

import itertools
import re
import string
import unicodedata
from functools import cache

#: White space as Unicode has it (str.split), as a regex class body.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@cache
def fold_pairs() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility decomposition without marks is one other character, and those."""
    pairs = []
    for c in map(chr, range(0x80, 0xFFFE)):
        if 0xAC00 <= ord(c) <= 0xD7A3 or 0xD800 <= ord(c) <= 0xDFFF:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ranges(points) -> str:
    """A regex class body of code points."""
    out = []
    for _, run in itertools.groupby(enumerate(sorted(points)), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append(f"\\x{{{run[0]:X}}}" + (f"-\\x{{{run[-1]:X}}}" if len(run) > 1 else ""))
    return "".join(out)


@cache
def combining() -> str:
    return ranges(p for p in range(0x300, 0xFFFE) if unicodedata.combining(chr(p)))


@cache
def digits() -> str:
    return ranges(p for p in range(0x10000) if chr(p).isdigit())


class Dialect:
    """Builders of SQL text. Lists are 1-based in neither argument nor result: at() counts from 0."""

    def __init__(self, duck: bool):
        self.duck, self._n = duck, 0

    def var(self) -> str:
        self._n += 1
        return f"v{self._n}"

    def lit(self, s: str) -> str:
        return "'" + (s.replace("'", "''") if self.duck else s.replace("\\", "\\\\").replace("'", "\\'")) + "'"

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}" if self.duck else f"{var} -> {body}"

    def transform(self, items: str, body) -> str:
        v = self.var()
        return f"{'list_transform' if self.duck else 'transform'}({items}, {self.fn(v, body(v))})"

    def where(self, items: str, body) -> str:
        v = self.var()
        return f"{'list_filter' if self.duck else 'filter'}({items}, {self.fn(v, body(v))})"

    def size(self, items: str) -> str:
        return f"CAST({'len' if self.duck else 'size'}({items}) AS BIGINT)"

    def distinct(self, items: str) -> str:
        return f"{'list_distinct' if self.duck else 'array_distinct'}({items})"

    def most(self, items: str, none: str = "0") -> str:
        return f"coalesce({'list_max' if self.duck else 'array_max'}({items}), {none})"

    def total(self, items: str) -> str:
        """The sum of a list of BIGINT."""
        return f"CAST(coalesce(list_sum({items}), 0) AS BIGINT)" if self.duck else f"aggregate({items}, 0L, (a, x) -> a + x)"

    def total_double(self, items: str) -> str:
        return f"coalesce(list_sum({items}), CAST(0 AS DOUBLE))" if self.duck else f"aggregate({items}, CAST(0 AS DOUBLE), (a, x) -> a + x)"

    def flat(self, items: str) -> str:
        return f"flatten({items})"

    def at(self, items: str, i: str) -> str:
        return f"list_extract({items}, CAST(({i}) + 1 AS BIGINT))" if self.duck else f"get({items}, CAST({i} AS INT))"

    def upto(self, n: str) -> str:
        """The list 0, 1 .. n - 1, empty for n below 1."""
        return f"range(0, CAST(greatest({n}, 0) AS BIGINT))" if self.duck else f"if(({n}) > 0, sequence(0, CAST(({n}) - 1 AS INT)), CAST(array() AS ARRAY<INT>))"

    def find(self, text: str, regex: str) -> str:
        """All matches; the regex has no group."""
        return f"regexp_extract_all({text}, {self.lit(regex)})" if self.duck else f"regexp_extract_all({text}, {self.lit(regex)}, 0)"

    def first(self, text: str, regex: str) -> str:
        return f"regexp_extract({text}, {self.lit(regex)}, 0)"

    def has(self, text: str, regex: str) -> str:
        return f"regexp_matches({text}, {self.lit(regex)})" if self.duck else f"({text} RLIKE {self.lit(regex)})"

    def swap(self, text: str, regex: str, by: str = "") -> str:
        return f"regexp_replace({text}, {self.lit(regex)}, {self.lit(by)}" + (", 'g')" if self.duck else ")")

    def join(self, items: str, by: str) -> str:
        return f"{'array_to_string' if self.duck else 'array_join'}({items}, {self.lit(by)})"

    def among(self, x: str, values) -> str:
        return f"{x} IN ({', '.join(self.lit(v) for v in values)})" if values else "false"

    def known_steps(self, items: str, name: str, words) -> list[tuple[str, str]]:
        """The steps that member() needs for the items among many words. Spark looks each up in a hash set; DuckDB intersects the distinct items with them."""
        if not self.duck:
            return []
        return [(name, f"list_intersect(list_distinct({items}), [{', '.join(self.lit(w) for w in words)}]::VARCHAR[])")]

    def member(self, x: str, name: str, words) -> str:
        """Whether x is one of many words; name: of the step that known_steps() gave."""
        return f"list_contains({name}, {x})" if self.duck else self.among(x, words)

    def rounded(self, x: str) -> str:
        """x to six digits, by the same operations in both dialects; ties, and what lies a millionth of a step below one, go up."""
        return f"(CAST(floor(({x}) * CAST(1000000 AS DOUBLE) + CAST(0.500001 AS DOUBLE)) AS DOUBLE) / CAST(1000000 AS DOUBLE))"

    def pair_values(self, text: str, table: list[int]) -> str:
        """For each neighbouring pair of characters of a text of a-z, blanks and ~ its value in table, which has 32 rows of 32: a blank's place is 0, a letter's 1 to 26, that of ~ 30."""
        v = self.var()
        if self.duck:
            codes = f"list_transform(string_split({text}, ''), lambda {v}: ascii({v}) & 31)"
            c, x = self.var(), self.var()
            return f"list_transform([{codes}], lambda {c}: list_transform(list_zip({c}[1:-2], {c}[2:]), lambda {x}: list_extract({self.longs(table)}, {x}[1] * 32 + {x}[2] + 1)))[1]"
        i, c = self.var(), self.var()
        # an array of one, so that the text is taken apart once; the last character has no pair and adds 0
        return f"get(transform(array(transform(split({text}, ''), {v} -> ascii({v}) & 31)), {c} -> transform({c}, ({v}, {i}) -> coalesce(get({self.longs(table)}, {v} * 32 + get({c}, {i} + 1)), 0L))), 0)"

    def chars(self, text: str) -> str:
        return self.where(f"string_split({text}, '')" if self.duck else f"split({text}, '')", lambda x: f"{x} <> ''")

    def runs(self, text: str, least: int) -> str:
        """Runs of at least `least` times the same of a-z and 0-9."""
        if self.duck:
            return self.find(text, "|".join(f"{c}{{{least},}}" for c in string.ascii_lowercase + string.digits))
        return self.find(text, rf"([a-z0-9])\1{{{least - 1},}}")

    def unit_steps(self, text: str, width: int, times: int, name: str) -> list[tuple[str, str]]:
        """Steps that end in `name`: the length of the longest stretch in which a unit of width characters, a letter or digit among them, stands at least `times` times."""
        if not self.duck:
            found = self.where(self.find(text, rf"(?d)(.{{{width}}})\1{{{times - 1},}}"), lambda m: self.has(f"substring({m}, 1, {width})", r"[\p{L}\p{N}]"))
            return [(name, self.most(self.transform(found, lambda m: f"CAST(length({m}) AS BIGINT)")))]
        # without back-references: runs of characters that equal the one a unit later; 1 marks letters and digits, 2 others
        c, e, need = f"{name}_c", f"{name}_e", width * (times - 1)
        mark = lambda x: f"CASE WHEN {x}[1] <> {x}[2] OR {x}[1] = chr(10) THEN '0' WHEN {self.has(f'{x}[1]', r'[\p{L}\p{N}]')} THEN '1' ELSE '2' END"
        good = self.where(self.find(e, f"[12]{{{need},}}"), lambda x: f"contains(substr({x}, 1, {width}), '1')")
        return [
            (c, self.chars(text)),
            (e, self.join(self.transform(f"list_zip({c}[1:-{width + 1}], {c}[{width + 1}:])", mark), "")),
            (name, self.most(self.transform(good, lambda x: f"CAST((length({x}) + {width}) // {width} * {width} AS BIGINT)"))),
        ]

    def count(self, text: str, char: str) -> str:
        return f"CAST(length({text}) - length(replace({text}, {self.lit(char)}, '')) AS BIGINT)"

    def part(self, text: str, start: str, n: str) -> str:
        """n characters from start, counted from 0."""
        return f"substring({text}, CAST({start} AS INT) + 1, CAST({n} AS INT))"

    def grams(self, word: str, n: int) -> str:
        return self.transform(self.upto(f"length({word}) - {n - 1}"), lambda i: self.part(word, i, str(n)))

    def longs(self, values) -> str:
        inner = ", ".join(map(str, values))
        return f"[{inner}]::BIGINT[]" if self.duck else f"array({', '.join(f'{v}L' for v in values)})"

    def num(self, x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    def ratio(self, a: str, b: str) -> str:
        """a / b in double; 0 where b is 0."""
        return f"(CASE WHEN ({b}) = 0 THEN {self.num(0.0)} ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"

    def fold(self, text: str) -> str:
        """Compatibility characters and accents reduced to their base. Texts in ASCII, the most, pass as they are."""
        a, b = fold_pairs()
        body = f"replace(replace(replace(replace({text}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'), '™', 'TM')"
        body = self.swap(f"translate({body}, {self.lit(a)}, {self.lit(b)})", f"[{combining()}]")
        return f"CASE WHEN {self.has(text, r'[^\x00-\x7F]')} THEN {body} ELSE {text} END"

    def squeeze(self, text: str) -> str:
        """Runs of three or more of one symbol become one. DuckDB's regexes know no back-references: there, for ASCII symbols."""
        if not self.duck:
            return self.swap(text, rf"([^\p{{L}}\p{{N}}_{WS}])\1{{2,}}", "$1")
        for c in string.punctuation.replace("_", ""):
            text = self.swap(text, re.escape(c) + "{3,}", c if c != "\\" else "\\\\")
        return text

    def again(self, text: str, symbols: str, width: int, times: int, flags: str = "") -> str:
        """Whether a unit of width symbols stands at least `times` times in a row. symbols: a regex class body; DuckDB spells units of its ASCII and Latin-1 members out."""
        if not self.duck:
            return self.has(text, flags.replace("i", "iu") + "".join([f"([{symbols}])"] * width) + "(" + "".join(f"\\{k + 1}" for k in range(width)) + f"){{{times - 1},}}")
        chars = [c for c in map(chr, range(33, 256)) if re.fullmatch(f"[{symbols.replace(chr(92) + 'p{L}', 'a-zß-öø-ÿ')}]", c)]
        return self.has(text, flags + "|".join(f"(?:{''.join(u)}){{{times},}}" for u in itertools.product(chars, repeat=width)))

    def tokens(self, text: str) -> str:
        """Runs of characters other than white space."""
        return self.find(text, f"[^{WS}]+")

    def blank(self, text: str) -> str:
        return f"NOT {self.has(text, f'[^{WS}]')}"
