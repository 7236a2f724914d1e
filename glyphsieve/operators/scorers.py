"""The 26 scorers: from a text to a probability, in [0, 1], that it is gibberish.

A scorer is a plan of named steps, each SQL over the steps before it, a score and whether the scorer applies at all.
Gates stand around every score: a null text gives null, a blank one 0, an over-long token without white space 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from ..functions import tables as T
from ..functions.dialect import WS, Dialect, digits, ranges
from .lexicon import UNSEEN, Lexicon, forbidden, never_start, seed

URLS = r"^(https?://|ftp://|file://|data:|www\.)"


@dataclass
class Plan:
    score: str
    steps: list[tuple[str, str]] = field(default_factory=list)
    applicable: str | None = None


def gates(q: Dialect, text: str, most: int = 1000) -> list[tuple[str, str]]:
    """The conditions that settle a score before its scorer is asked, and the scores."""
    long_ = f"length({text}) > {most} AND NOT {q.has(text, f'[{WS}]')} AND NOT {q.has(f'lower({text})', URLS)}"
    return [(f"{text} IS NULL", "CAST(NULL AS DOUBLE)"), (q.blank(text), q.num(0.0)), (long_, q.num(1.0))]


@dataclass(frozen=True)
class Scorer:
    name: str
    build: Callable
    defaults: dict
    checks: tuple

    def params(self, given: dict) -> dict:
        p = {**self.defaults, **given}
        for test, message in self.checks:
            if not test(p):
                raise ValueError(message)
        return p

    def plan(self, q: Dialect, text: str, lexicon: Lexicon | None = None, **given) -> Plan:
        plan = self.build(q, text, lexicon or seed(), self.params(given))
        settled = " ".join(f"WHEN {a} THEN {b}" for a, b in gates(q, text, given.get("max_string_length", 1000)))
        return Plan(f"CASE {settled} ELSE CAST({plan.score} AS DOUBLE) END", plan.steps, plan.applicable)


@dataclass(frozen=True)
class ColumnScorer(Scorer):
    """A scorer given as a function of a column, a Pandas UDF for instance: build(text, **params) -> Column. It has no SQL of its own."""

    applies: Callable | None = None


REGISTRY: dict[str, Scorer] = {}


def scorer(name: str, checks: tuple = (), **defaults):
    """Register a builder (dialect, text, lexicon, params) -> Plan, SQL that both dialects can run."""

    def add(build):
        REGISTRY[name] = Scorer(name, build, defaults, checks)
        return build

    return add


def column_scorer(name: str, checks: tuple = (), applies: Callable | None = None, **defaults):
    """Register (text column, **params) -> column of scores in [0, 1]; applies: (text column) -> boolean column. A name can't be taken twice."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"a scorer is named {name} already")
        REGISTRY[name] = ColumnScorer(name, build, defaults, checks, applies)
        return build

    return add


def within(key: str):
    return (lambda p: 0.0 <= p[key] <= 1.0), f"{key} must be between 0.0 and 1.0"


def least(key: str, n: int):
    return (lambda p: p[key] >= n), f"{key} must be at least {n}" if n else f"{key} must be non-negative"


def clamp(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"greatest(CAST({lo} AS DOUBLE), least(CAST({hi} AS DOUBLE), {x}))"


def letters(q: Dialect, x: str) -> str:
    return q.swap(x, r"[^\p{L}]")


def upper_word(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def plain(q: Dialect, t: str) -> str:
    """Words [a-z]+ of the folded, lower-cased text."""
    return q.find(f"lower({q.fold(t)})", "[a-z]+")


def novel(q: Dialect, t: str, lex: Lexicon, titles: bool = False) -> list[tuple[str, str]]:
    """Steps to w: lower-case words that nothing vouches for: no digits, addresses, acronyms, known words, nor, if titles, capitalised ones."""
    keep = q.where(q.tokens(t), lambda x: f"NOT {q.has(x, f'[{digits()}]')} AND NOT {q.has(f'lower({x})', r'://|@|^www\.')}" + (f" AND NOT ({q.has(x, r'^\p{Lu}')} AND lower(substring({x}, 2)) = substring({x}, 2))" if titles else ""))
    bare = q.transform(keep, lambda x: f"CASE WHEN {upper_word(x)} AND length({letters(q, x)}) <= 6 THEN '' ELSE lower({letters(q, q.fold(x))}) END")
    return [("bare", q.where(bare, lambda x: f"{x} <> ''")), *q.known_steps("bare", "dict", lex.words), ("w", q.where("bare", lambda x: f"NOT {q.member(x, 'dict', lex.words)}"))]


@cache
def pair_table(lex: Lexicon, across: bool = True) -> tuple[int, ...]:
    """The lexicon's pairs in 32 rows of 32; pairs with a blank count as 0 unless across."""
    at = lambda r, c: 0 if not across and not r * c else lex.pairs[r * 27 + c] if r < 27 and c < 27 else UNSEEN
    return tuple(at(r, c) for r in range(32) for c in range(32))


def padded(q: Dialect, words: str) -> str:
    """The words with a blank between and around them, other letters than a-z as ~: its pairs are those of the padded words."""
    return f"concat(' ', {q.swap(q.join(words, ' '), '[^a-z ]', '~')}, ' ')"


def pair_total(q: Dialect, lex: Lexicon, text: str, across: bool = True) -> str:
    """The sum of a padded text's pair log-probabilities, in millionths."""
    return q.total(q.pair_values(text, pair_table(lex, across)))


def lengths(q: Dialect, items: str, extra: int = 0) -> str:
    return q.total(q.transform(items, lambda x: f"CAST(length({x}) + {extra} AS BIGINT)"))


def longest(q: Dialect, items: str) -> str:
    return q.most(q.transform(items, lambda x: f"CAST(length({x}) AS BIGINT)"))


def hits(q: Dialect, items: str, values) -> str:
    return q.size(q.where(items, lambda x: q.among(x, values)))


def title_share(q: Dialect, t: str) -> str:
    return q.ratio(q.size(q.where(q.tokens(t), lambda x: q.has(x, r"^\p{Lu}"))), q.size(q.tokens(t)))


@scorer("markov_chain", (((lambda p: p["threshold_per_char"] <= 0), "threshold_per_char must be <= 0"), least("min_length", 1)), threshold_per_char=-3.5, min_length=3)
def _markov(q, t, lex, p):
    z = f"-2 * ({q.num(p['threshold_per_char'])} - CAST({pair_total(q, lex, 's')} AS DOUBLE) / 1000000 / n)"
    return Plan(f"CASE WHEN n - 1 < {p['min_length']} THEN 0 ELSE 1 / (1 + exp({z})) END", [*novel(q, t, lex), ("n", lengths(q, "w", 1)), ("s", padded(q, "w"))])


@scorer("ngram_frequency", (within("common_ratio_threshold"), least("min_length", 1)), common_ratio_threshold=0.3, min_length=4)
def _ngram(q, t, lex, p):
    c, one = q.num(p["common_ratio_threshold"]), p["common_ratio_threshold"] == 1
    above = "0" if one else f"0.4 * (1 - (r - {c}) / (1 - {c}))"
    steps = [*novel(q, t, lex), ("g", q.flat(q.transform("w", lambda w: q.grams(w, 3)))), *q.known_steps("g", "common", lex.trigrams)]
    steps.append(("r", f"CASE WHEN {q.size('g')} = 0 THEN {q.num(1.0)} ELSE {q.ratio(q.size(q.where('g', lambda x: q.member(x, 'common', lex.trigrams))), q.size('g'))} END"))
    return Plan(f"CASE WHEN length({letters(q, t)}) < {p['min_length']} THEN 0 WHEN r >= {c} THEN {above} ELSE 1 - 0.5 * r / {c} END", steps)


@scorer("log_likelihood_ratio", llr_midpoint=-1.0, llr_scale=1.5, min_bigrams=3)
def _llr(q, t, lex, p):
    mean = f"(CAST({pair_total(q, lex, 's')} AS DOUBLE) / 1000000 / n + ln(CAST(27 AS DOUBLE)))"
    z = clamp(f"{q.num(p['llr_scale'])} * ({mean} - {q.num(p['llr_midpoint'])})", "-50", "50")
    return Plan(f"CASE WHEN n < {p['min_bigrams']} OR n = 0 THEN 0 ELSE 1 / (1 + exp({z})) END", [("plain", plain(q, t)), ("n", lengths(q, "plain", 1)), ("s", padded(q, "plain"))], f"n >= {p['min_bigrams']}")


@scorer("word_anomaly", word_log_prob_threshold=-4.6, min_word_length=4, anomaly_weight=2.0)
def _anomaly(q, t, lex, p):
    odd = q.size(q.where("w", lambda w: f"CAST({pair_total(q, lex, f"concat(' ', {w}, ' ')")} AS DOUBLE) / 1000000 / (length({w}) + 1) < {q.num(p['word_log_prob_threshold'])}"))
    return Plan(f"least(CAST(1 AS DOUBLE), {q.num(p['anomaly_weight'])} * {q.ratio(odd, q.size('w'))})", [("plain", plain(q, t)), ("w", q.where("plain", lambda w: f"length({w}) >= {p['min_word_length']}"))], f"{q.size('w')} >= 1")


@scorer("entropy_based")
def _entropy(q, t, lex, p):
    steps = [
        ("w", q.where(q.transform(q.tokens(f"lower({q.fold(t)})"), lambda x: letters(q, x)), lambda x: f"{x} <> ''")),
        ("s", q.join("w", "")),
        ("n", "CAST(length(s) AS BIGINT)"),
        ("c", q.transform(q.distinct(q.chars("s")), lambda x: f"CAST(length(s) - length(replace(s, {x}, '')) AS DOUBLE) / n")),
        ("h", f"-({q.total_double(q.transform('c', lambda x: f'{x} * ln({x}) / ln(CAST(2 AS DOUBLE))'))})"),
        ("k", q.total(q.transform("w", lambda w: f"CAST(length({w}) - 1 AS BIGINT)"))),
        ("z", padded(q, "w")),
        ("b", f"CASE WHEN k = 0 THEN {q.num(0.0)} ELSE {clamp(f'(-(CAST({pair_total(q, lex, "z", False)} AS DOUBLE) / 1000000 / k) - 4.5) / 3')} END"),
    ]
    top = "CASE WHEN n > 1 THEN least(CAST(4.1 AS DOUBLE), ln(CAST(n AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) ELSE CAST(4.1 AS DOUBLE) END"
    return Plan(f"CASE WHEN n = 0 THEN 0 ELSE 0.4 * (1 - least(h / ({top}), CAST(1 AS DOUBLE))) + 0.6 * b END", steps)


@scorer("bigram_probability", threshold=0.3, min_length=4)
def _bigrams(q, t, lex, p):
    steps = [("w", q.transform(q.tokens(f"lower({q.fold(t)})"), lambda x: letters(q, x))), ("g", q.flat(q.transform("w", lambda w: q.grams(w, 2)))), ("r", q.ratio(hits(q, "g", T.IMPOSSIBLE_BIGRAMS), q.size("g")))]
    c = q.num(p["threshold"])
    return Plan(f"CASE WHEN {lengths(q, 'w')} < {p['min_length']} THEN 0 WHEN r >= {c} THEN 1 WHEN r > 0 THEN least(CAST(0.6 AS DOUBLE), 0.6 * r / {c}) ELSE 0 END", steps)


@scorer("rare_trigram", threshold=0.15, min_length=6)
def _trigrams(q, t, lex, p):
    steps = [("w", plain(q, t)), ("g", q.flat(q.transform("w", lambda w: q.grams(w, 3)))), ("r", q.ratio(hits(q, "g", list(dict.fromkeys(T.IMPOSSIBLE_TRIGRAMS))), q.size("g")))]
    c = q.num(p["threshold"])
    return Plan(f"CASE WHEN {lengths(q, 'w')} < {p['min_length']} OR r = 0 THEN 0 WHEN r >= {c} THEN least(CAST(1 AS DOUBLE), 0.5 + r) ELSE 0.4 * r / {c} END", steps)


@scorer("letter_position", threshold=0.25, min_word_length=3)
def _position(q, t, lex, p):
    steps = [
        ("w", q.where(q.find(f"lower({t})", r"\p{L}+"), lambda x: f"length({x}) >= {max(2, p['min_word_length'])}")),
        ("k", f"{q.size(q.where('w', lambda x: q.among(f'substring({x}, 1, 2)', never_start())))} + {q.size(q.where('w', lambda x: f'{x} LIKE {q.lit("%j")}'))}"),
        ("r", q.ratio("k", f"2 * {q.size('w')}")),
    ]
    c = q.num(p["threshold"])
    return Plan(f"CASE WHEN k = 0 THEN 0 WHEN k < 2 AND {q.size('w')} < 2 THEN least(CAST(0.4 AS DOUBLE), 0.4 * r / {c}) WHEN r >= {c} THEN least(CAST(1 AS DOUBLE), 0.5 + r) ELSE 0.4 * r / {c} END", steps)


@scorer("consonant_sequence", max_consonants=6, min_length=6)
def _consonants(q, t, lex, p):
    m = p["max_consonants"]
    words = q.transform(q.where(q.find(t, r"\p{L}+"), lambda x: f"NOT ({upper_word(x)} AND length({x}) <= 6)"), lambda x: f"lower({x})")
    steps = [("s", q.join(words, " ")), ("r", q.transform(q.find("s", "[bcdfghjklmnpqrstvwxz]+"), lambda x: f"CAST(length({x}) AS BIGINT)")), ("m", q.most("r")), ("k", q.size(q.where("r", lambda x: f"{x} > {m}")))]
    return Plan(f"CASE WHEN length(s) < {p['min_length']} THEN 0 WHEN m >= {m + 3} THEN 1 WHEN m > {m} THEN least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (m - {m}) + CASE WHEN k > 1 THEN CAST(0.1 AS DOUBLE) * k ELSE 0 END) ELSE 0 END", steps)


@scorer("vowel_pattern", max_vowel_run=4, min_length=5)
def _vowels(q, t, lex, p):
    m = p["max_vowel_run"]
    steps = [("r", q.where(q.find(f"lower({t})", "[aeiou]{3,}"), lambda x: f"length({x}) > {m} AND NOT {q.among(x, T.VALID_LONG_VOWELS)}")), ("k", q.size("r"))]
    return Plan(f"CASE WHEN length({letters(q, t)}) < {p['min_length']} OR k = 0 THEN 0 ELSE least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * ({longest(q, 'r')} - {m}) + CAST(0.15 AS DOUBLE) * (k - 1)) END", steps)


@scorer("letter_frequency", deviation_threshold=1.0, min_length=20)
def _letters(q, t, lex, p):
    steps = [*novel(q, t, lex), ("s", q.join("w", "")), ("n", "CAST(length(s) AS BIGINT)"), ("c", ("[" if q.duck else "array(") + ", ".join(q.count("s", x) for x in sorted(T.ENGLISH_PERCENT)) + ("]" if q.duck else ")"))]
    alphabet = sorted(T.ENGLISH_PERCENT)
    some = lambda of: " + ".join(q.at("c", str(alphabet.index(x))) for x in of)
    other = q.most(q.transform(q.distinct(q.find("s", "[^a-z]")), lambda x: f"CAST(length(s) - length(replace(s, {x}, '')) AS BIGINT)"))
    steps.append(("e", f"least(CAST(1 AS DOUBLE), CASE WHEN {q.ratio(some('jxqz'), 'n')} > 0.15 THEN CAST(0.4 AS DOUBLE) ELSE 0 END + CASE WHEN {q.ratio(some('etaoinsr'), 'n')} < 0.30 THEN CAST(0.4 AS DOUBLE) ELSE 0 END + CASE WHEN {q.ratio(f'greatest({q.most("c")}, {other})', 'n')} > 0.30 THEN CAST(0.3 AS DOUBLE) ELSE 0 END)"))
    want = {x: f"greatest({q.num(v / 100)} * n, CAST(0.5 AS DOUBLE))" for x, v in T.ENGLISH_PERCENT.items()}
    chi = " + ".join(f"(({q.at('c', str(i))} - {want[x]}) * ({q.at('c', str(i))} - {want[x]}) / {want[x]})" for i, x in enumerate(alphabet))
    steps.append(("d", f"CASE WHEN n = 0 THEN {q.num(0.0)} ELSE ({chi}) / n END"))
    c = q.num(p["deviation_threshold"])
    return Plan(f"CASE WHEN n < {max(1, p['min_length'])} THEN 0 WHEN e >= 0.7 THEN e WHEN d > {c} THEN least(CAST(1 AS DOUBLE), 0.4 + 0.1 * (d - {c})) ELSE greatest(e, 0.3 * d / {c}) END", steps)


@scorer("keyboard_pattern")
def _keyboard(q, t, lex, p):
    rows = sorted({x for r in T.KEYBOARD_ROWS for i in range(len(r) - 2) for x in (r[i : i + 3], r[i : i + 3][::-1])})
    steps = [*novel(q, t, lex), ("g", q.flat(q.transform("w", lambda w: q.grams(w, 3)))), ("n", q.size("g"))]
    common = f"CASE WHEN n >= 15 THEN 0.7 * greatest(CAST(0 AS DOUBLE), 1 - {q.ratio(hits(q, 'g', T.KEYBOARD_COMMON), 'n')} / 0.15) * least(CAST(1 AS DOUBLE), CAST(n AS DOUBLE) / 28) ELSE 0 END"
    again = f"CASE WHEN {q.again(f'lower({letters(q, t)})', r'\p{L}', 2, 3)} THEN CAST(0.5 AS DOUBLE) ELSE 0 END"
    return Plan(f"least(CAST(1 AS DOUBLE), greatest(least({q.ratio(hits(q, 'g', rows), 'n')} / 0.3, CAST(1 AS DOUBLE)), {common}, {again}))", steps)


def _neighbours() -> list[str]:
    """Ordered pairs of keys that touch on three staggered rows, and of equal keys."""
    place = {c: (2 * i + row, row) for row, keys in enumerate(T.KEYBOARD_ROWS) for i, c in enumerate(keys)}
    near = lambda a, b: abs(a[0] - b[0]) == 2 and a[1] == b[1] or abs(a[0] - b[0]) == 1 and abs(a[1] - b[1]) == 1
    return sorted(x + y for x in place for y in place if x == y or near(place[x], place[y]))


@scorer("keyboard_adjacency", min_word_length=5, chain_threshold=6, row_run_threshold=6)
def _adjacency(q, t, lex, p):
    steps = [("plain", plain(q, t)), ("w", q.where("plain", lambda x: f"length({x}) >= {p['min_word_length']}")), *q.known_steps("w", "dict", lex.words)]
    touch = _neighbours()
    chain = lambda x: longest(q, q.find(q.join(q.transform(q.grams(x, 2), lambda g: f"CASE WHEN {q.among(g, touch)} THEN '1' ELSE '0' END"), ""), "1+")) + " + 1"
    rows = lambda x: longest(q, q.find(x, "|".join(f"[{r}]+" for r in T.KEYBOARD_ROWS)))
    mashed = q.size(q.where("w", lambda x: f"NOT {q.member(x, 'dict', lex.words)} AND ({chain(x)} >= {p['chain_threshold']} OR (length({q.swap(x, '[^aeiou]')}) <= 1 AND {rows(x)} >= {p['row_run_threshold']}))"))
    steps.append(("k", mashed))
    return Plan(f"CASE WHEN k = 0 THEN 0 ELSE least(CAST(1 AS DOUBLE), 0.6 + 0.4 * k / CAST({q.size('w')} AS DOUBLE)) END", steps)


@scorer("word_lookup", (within("unknown_threshold"), least("min_word_length", 1)), unknown_threshold=0.5, min_word_length=2)
def _lookup(q, t, lex, p):
    steps = [("w", q.where(q.find(q.fold(t), "[a-zA-Z]+"), lambda x: f"length({x}) >= {p['min_word_length']}")), *q.known_steps(q.transform("w", lambda x: f"lower({x})"), "dict", lex.words), ("u", q.where("w", lambda x: f"NOT {q.member(f'lower({x})', 'dict', lex.words)}"))]
    return Plan(q.ratio(f"({q.size('u')} - 0.5 * {q.size(q.where('u', lambda x: q.has(x, '^[A-Z][a-z]*$')))})", q.size("w")), steps)


@scorer("function_word_density", (within("min_ratio"), least("min_words", 1)), min_ratio=0.08, min_words=5, min_word_length=2)
def _function_words(q, t, lex, p):
    c = q.num(p["min_ratio"])
    steps = [("w", q.where(q.find(f"lower({t})", "[a-z]+"), lambda x: f"length({x}) >= {p['min_word_length']}")), ("n", q.size("w")), ("k", hits(q, "w", T.FUNCTION_WORDS)), ("u", title_share(q, t))]
    none = "CASE WHEN u >= 0.6 THEN 0.3 WHEN n >= 15 THEN 0.9 WHEN n >= 10 THEN 0.8 ELSE 0.3 END"
    r = q.ratio("k", "n")
    return Plan(f"CASE WHEN n < {p['min_words']} THEN 0 WHEN k = 0 THEN {none} WHEN {r} < {c} THEN least(CAST(0.45 AS DOUBLE), 0.2 + ({c} - {r}) / {c} * 0.25) ELSE 0 END", steps, f"n >= {p['min_words']}")


@scorer("affix_detection", (within("min_affix_ratio"), least("min_word_length", 2)), min_affix_ratio=0.2, min_word_length=4, min_analyzable_words=5, min_stem_length=2)
def _affixes(q, t, lex, p):
    k = p["min_stem_length"]
    stem = "(?:" + "|".join(f"[a-z]{{{i}}}[a-z]*?[aeiouy][a-z]{{{k - 1 - i},}}" if i == 0 else f"[a-z]{{{i}}}[aeiouy][a-z]{{{max(0, k - 1 - i)},}}" for i in range(k)) + ")" if k > 0 else "[a-z]*[aeiouy][a-z]*"
    hit = lambda x: f"({q.has(x, f'^(?:{"|".join(T.AFFIX_PREFIXES)}){stem}$')} OR {q.has(x, f'^{stem}(?:{"|".join(T.AFFIX_SUFFIXES)})$')})"
    c = q.num(p["min_affix_ratio"])
    steps = [("w", q.where(q.find(f"lower({t})", "[a-z]+"), lambda x: f"length({x}) >= {p['min_word_length']}")), ("n", q.size("w")), ("k", q.size(q.where("w", hit)))]
    r = q.ratio("k", "n")
    some = f"least(CAST(0.75 AS DOUBLE), 0.3 + 0.25 * ({c} - {r}) / {c} + CASE WHEN n >= 20 THEN 0.15 ELSE 0 END)"
    return Plan(f"CASE WHEN n < {p['min_analyzable_words']} OR {r} >= {c} THEN 0 WHEN k = 0 THEN CASE WHEN n >= 20 THEN 0.5 WHEN n >= 10 THEN 0.45 ELSE 0.35 END ELSE {some} END", steps, f"n >= {p['min_analyzable_words']}")


@scorer("zipf_conformity", (least("min_words", 5), within("ttr_threshold"), within("hapax_threshold")), min_words=30, ttr_threshold=0.95, hapax_threshold=0.95)
def _zipf(q, t, lex, p):
    a, b = q.num(p["ttr_threshold"]), q.num(p["hapax_threshold"])
    alone = lambda i: f"(({i}) = 0 OR {q.at('s', f'{i} - 1')} <> {q.at('s', i)}) AND (({i}) = n - 1 OR {q.at('s', f'{i} + 1')} <> {q.at('s', i)})"
    steps = [
        ("s", f"{'list_sort' if q.duck else 'array_sort'}({q.find(f'lower({t})', '[a-z]+')})"),
        ("n", q.size("s")),
        ("r", q.ratio(q.size(q.distinct("s")), "n")),
        ("h", q.ratio(q.size(q.where(q.upto("n"), alone)), "n")),
        *q.known_steps("s", "dict", lex.words),
        ("known", f"{hits(q, 's', T.FUNCTION_WORDS)} > 0 OR {q.ratio(q.size(q.where('s', lambda x: f'NOT {q.member(x, "dict", lex.words)}')), 'n')} < 0.5"),
    ]
    over = lambda x, c, v: f"CASE WHEN {x} > {c} THEN 0.45 * ({x} - {c}) / (1 - {c}) ELSE 0 END" if v < 1 else "0"
    raw = f"CASE WHEN r = 1 THEN CAST(0.9 AS DOUBLE) ELSE {clamp(f'{over("r", a, p["ttr_threshold"])} + {over("h", b, p["hapax_threshold"])} + CASE WHEN r > {a} AND h > {b} THEN 0.1 ELSE 0 END')} END"
    return Plan(f"CASE WHEN n < {p['min_words']} THEN 0 WHEN known THEN least(CAST(0.45 AS DOUBLE), {raw}) ELSE {raw} END", steps, f"n >= {p['min_words']}")


@scorer("word_collocation", (least("min_words", 2),), min_words=8, zero_collocation_min_words=12)
def _collocations(q, t, lex, p):
    trimmed = q.where(q.transform(q.find(f"lower({t})", "[a-z']+"), lambda x: f"trim(BOTH {q.lit(chr(39))} FROM {x})" if not q.duck else f"trim({x}, {q.lit(chr(39))})"), lambda x: f"{x} <> ''")
    common = lambda a, b: " OR ".join(f"({q.among(a, left)} AND {q.among(b, right)})" for left, right in T.COLLOCATION_RULES)
    named = q.where(q.tokens(t), lambda x: q.has(x, r"\p{L}"))
    steps = [
        ("w", trimmed),
        ("n", q.size("w")),
        ("k", q.size(q.where(q.upto("n - 1"), lambda i: common(q.at("w", i), q.at("w", f"{i} + 1"))))),
        ("u", q.ratio(q.size(q.where(named, lambda x: q.has(x, r"^\P{L}*\p{Lu}"))), q.size(named))),
        ("m", q.size(q.where("w", lambda x: f"length({x}) >= 3"))),
    ]
    none = f"CASE WHEN u >= 0.6 THEN 0.3 WHEN n >= 20 THEN 0.7 WHEN n >= {p['zero_collocation_min_words']} THEN 0.6 ELSE 0.3 END"
    return Plan(f"CASE WHEN n < {p['min_words']} OR m < {p['min_words'] // 2} THEN 0 WHEN k = 0 THEN {none} WHEN n >= 15 AND {q.ratio('k', 'n - 1')} < 0.02 THEN 0.55 ELSE 0 END", steps, f"n >= {p['min_words']}")


@scorer("pronounceability", (least("forbidden_cluster_threshold", 1), least("min_word_length", 2), within("vowel_min_ratio")), forbidden_cluster_threshold=2, min_word_length=3, vowel_min_ratio=0.1)
def _pronounce(q, t, lex, p):
    c = "bcdfghjklmnpqrstvwxz"
    steps = [
        *novel(q, t, lex, True),
        ("x4", q.where("w", lambda x: f"length({x}) >= 4")),
        ("long", q.where("x4", lambda x: f"length({x}) >= {p['min_word_length']}")),
        ("o", q.transform("long", lambda x: q.first(x, f"^y?[{c}]*"))),
        ("e", q.transform("long", lambda x: f"CASE WHEN {q.first(x, f'(?:^y)?[{c}]*$')} = {q.first(x, f'^y?[{c}]*')} THEN '' ELSE {q.first(x, f'(?:^y)?[{c}]*$')} END")),
        ("f", " + ".join(hits(q, q.flat(q.transform(q.where(side, lambda x, ok=ok: f"length({x}) >= 2 AND NOT {q.among(x, ok)}"), lambda x: q.grams(x, 2))), sorted(set(forbidden()) - set(ok))) for side, ok in (("o", T.ONSETS), ("e", T.CODAS)))),
        ("n", lengths(q, "x4")),
        ("v", q.ratio(q.total(q.transform("x4", lambda x: f"CAST(length({q.swap(x, '^y|[^aeiouy]')}) AS BIGINT)")), "n")),
        ("many", q.where("o", lambda x: f"length({x}) >= 2")),
        ("x1", f"CASE WHEN f >= {p['forbidden_cluster_threshold']} THEN least(CAST(1 AS DOUBLE), CAST(0.6 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f) END"),
        ("x2", f"CASE WHEN n > 0 AND v < {q.num(p['vowel_min_ratio'])} THEN 1 - v / {q.num(max(p['vowel_min_ratio'], 1e-12))} END"),
        ("x3", f"CASE WHEN {q.ratio(q.size(q.where('many', lambda x: f'NOT {q.among(x, T.ONSETS)}')), q.size('many'))} > 0.3 THEN {q.ratio(q.size(q.where('many', lambda x: f'NOT {q.among(x, T.ONSETS)}')), q.size('many'))} END"),
    ]
    total = "(coalesce(x1, CAST(0 AS DOUBLE)) + coalesce(x2, CAST(0 AS DOUBLE)) + coalesce(x3, CAST(0 AS DOUBLE)))"
    count = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in ("x1", "x2", "x3"))
    return Plan(f"CASE WHEN length({t}) < 3 OR ({count}) = 0 THEN 0 ELSE 0.7 * greatest(x1, x2, x3) + 0.3 * {total} / ({count}) END", steps)


@scorer("vowel_ratio", min_vowel_ratio=0.15, max_vowel_ratio=0.65, consonant_cluster_len=4)
def _vowel_ratio(q, t, lex, p):
    lo, hi, k = p["min_vowel_ratio"], p["max_vowel_ratio"], p["consonant_cluster_len"]
    acronym = lambda x: f"length({x}) > 1 AND {q.has(x, r'^\p{L}+$')} AND {upper_word(x)}"
    kept = q.where(q.tokens(t), lambda x: f"NOT (length({x}) <= 6 AND {acronym(x)})")
    steps = [
        ("w", q.transform(kept, lambda x: f"lower({x})")),
        # y stands for a vowel in words without another
        ("y", q.transform("w", lambda x: f"CASE WHEN {q.has(x, '[aeiou]')} THEN {x} ELSE replace({x}, 'y', 'i') END")),
        ("n", q.total(q.transform("y", lambda x: f"CAST(length({letters(q, x)}) AS BIGINT)"))),
        ("r", q.ratio(q.total(q.transform("y", lambda x: f"CAST(length({q.swap(x, '[^aeiou]')}) AS BIGINT)")), "n")),
        ("m", q.most(q.transform("y", lambda x: longest(q, q.find(q.swap(x, "[aeiou]", " "), r"\p{L}+"))))),
    ]
    low = f"CASE WHEN r < {lo} THEN ({lo} - r) / {lo} " if lo > 0 else "CASE "
    high = f"WHEN r > {hi} THEN (r - {hi}) / {q.num(1.0 - hi)} ELSE CAST(0 AS DOUBLE) END" if hi < 1 else "WHEN r > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    cluster = f"CASE WHEN m >= {k} THEN least(CAST(m - {k} AS DOUBLE) / 4, CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"
    return Plan(f"CASE WHEN n = 0 THEN 0 ELSE least(greatest({low}{high}, {cluster}), CAST(1 AS DOUBLE)) END", steps)


@scorer("pattern_matching", patterns=None, override_defaults=False)
def _patterns(q, t, lex, p):
    mine = p["patterns"] or {}
    chosen = mine if p["override_defaults"] else {**T.PATTERNS, **mine}
    java = {k: v.replace(r"[^a-zA-Z0-9\s]", f"[^a-zA-Z0-9{WS}]").replace("(?i)", "(?iu)") for k, v in chosen.items()}
    s = q.join(q.where(q.tokens(t), lambda x: f"NOT {q.has(f'lower({x})', r'://|@|^www\.')}"), " ")
    # two of the patterns refer back; they are spelled so that both dialects can run them
    back = {T.PATTERNS["repeated_chars"]: ("a-zA-Z0-9", 1, 4, ""), T.PATTERNS["alternating_pattern"]: ("a-z0-9", 2, 3, "(?i)")}
    found = lambda k: q.again("s", *back[chosen[k]]) if chosen[k] in back else q.has("s", java[k].replace("(?iu)", "(?i)") if q.duck else java[k])
    total = lambda of: " + ".join(f"CASE WHEN {found(k)} THEN 1 ELSE 0 END" for k in of) or "0"
    steps = [("s", s), ("a", total([k for k in java if k not in T.WEAK_PATTERNS])), ("b", total([k for k in java if k in T.WEAK_PATTERNS]))]
    return Plan("CASE WHEN a + b = 0 THEN 0 WHEN a = 0 THEN least(CAST(0.3 AS DOUBLE) + CAST(0.08 AS DOUBLE) * (b - 1), CAST(0.45 AS DOUBLE)) ELSE least(CAST(0.65 AS DOUBLE) + CAST(0.08 AS DOUBLE) * (a - 1 + b), CAST(1 AS DOUBLE)) END", steps)


@scorer("symbol_ratio", (within("symbol_threshold"), least("min_length", 0)), symbol_threshold=0.5, min_length=3, allow_spaces=True, count_digits=False)
def _symbols(q, t, lex, p):
    c = p["symbol_threshold"]
    s = q.squeeze(t)
    steps = [
        ("s", q.swap(s, f"[{WS}]") if p["allow_spaces"] else s),
        ("n", "CAST(length(s) AS BIGINT)"),
        ("r", q.ratio(f"length({q.swap('s', r'\p{L}' if p['count_digits'] else rf'[\p{{L}}{digits()}]')})", "n")),
    ]
    low = f"0.4 * r / {c!r}" if c > 0 else "0.4"
    high = f"0.5 + 0.5 * (r - {c!r}) / {1.0 - c!r}" if c < 1 else "1"
    return Plan(f"CASE WHEN n < {p['min_length']} OR n = 0 OR r = 0 THEN 0 WHEN r <= {q.num(c)} THEN {low} ELSE {high} END", steps)


@scorer("repetition", (least("max_char_repeat", 1), least("max_pattern_repeat", 1), within("diversity_threshold")), max_char_repeat=3, max_pattern_repeat=3, diversity_threshold=0.3)
def _repetition(q, t, lex, p):
    d = p["diversity_threshold"]
    steps = [
        ("s", f"lower({t})"),
        ("w", q.find("s", "[a-z0-9]+")),
        ("n", q.size("w")),
        # a word with most of the places holds the middle one of the sorted words
        ("sorted", f"{'list_sort' if q.duck else 'array_sort'}(w)"),
        ("middle", q.at("sorted", "floor(n / 2)")),
        ("k", q.size(q.where("w", lambda x: f"{x} = middle"))),
        ("cycle", f"n >= 5 AND {q.at('w', '0')} <> {q.at('w', '1')} AND {q.size(q.where(q.upto('n'), lambda i: f'{q.at("w", i)} <> {q.at("w", f"{i} % 2")}'))} = 0"),
        ("chars", q.find("s", r"[\p{L}\p{N}]")),
        ("m", q.size("chars")),
        ("v", f"CASE WHEN m < 4 THEN {q.num(1.0)} ELSE CAST({q.size(q.distinct('chars'))} AS DOUBLE) / least(m, CAST(36 AS BIGINT)) END"),
        *q.unit_steps("s", 2, p["max_pattern_repeat"] + 1, "two"),
        *q.unit_steps("s", 3, p["max_pattern_repeat"], "three"),
    ]
    unit = lambda of, by: f"least(CAST(1 AS DOUBLE), CAST({of} AS DOUBLE) / {by})"
    words = f"CASE WHEN n < 3 THEN CAST(0 AS DOUBLE) WHEN k >= 3 AND {q.ratio('k', 'n')} >= 0.6 THEN {q.ratio('k', 'n')} WHEN cycle THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    few = f"CASE WHEN m >= 4 AND v < {q.num(d)} THEN 1 - v / {q.num(d)} ELSE CAST(0 AS DOUBLE) END" if d > 0 else "CAST(0 AS DOUBLE)"
    chars = f"least(CAST(1 AS DOUBLE), CAST({longest(q, q.runs('s', p['max_char_repeat'] + 1))} AS DOUBLE) / 10)"
    return Plan(f"CASE WHEN length(s) < 3 THEN 0 ELSE greatest({chars}, {unit('two', 12)}, {unit('three', 15)}, {words}, {few}) END", steps)


@scorer("hex_string", (least("min_hex_length", 0), within("hex_ratio_threshold")), min_hex_length=16, hex_ratio_threshold=0.7)
def _hex(q, t, lex, p):
    c, k = p["hex_ratio_threshold"], p["min_hex_length"]
    alnum = lambda x: q.swap(x, r"[^\p{L}\p{N}]")
    tokens = q.where(q.transform(q.tokens(t), alnum), lambda x: f"length({x}) >= {max(8, k // 2)} AND {q.has(x, '[a-fA-F]')} AND {q.has(x, f'[{digits()}]')}")
    steps = [
        ("s", q.swap(q.swap(t, f"^[{WS}]+"), f"[{WS}]+$")),
        ("b", f"{q.has('s', '^[A-Za-z0-9+/]{20,}={0,2}$')} AND ({q.has('s', '[+/=]')} OR ({q.has('s', '[0-9]')} AND {q.has('s', '[a-z]')} AND {q.has('s', '[A-Z]')}))"),
        ("u", f"{q.has(t, '[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}')} AND {q.size(q.tokens(t))} <= 2"),
        ("m", longest(q, q.where(q.find(t, f"[a-fA-F0-9]{{{max(1, k)},}}"), lambda x: q.has(x, "[a-fA-F]")))),
        ("r", q.most(q.transform(tokens, lambda x: f"CAST(length({q.swap(x, '[^0-9a-fA-F]')}) AS DOUBLE) / length({x})"), "CAST(0 AS DOUBLE)")),
    ]
    ratio = f"0.6 + 0.4 * (r - {c!r}) / {1.0 - c!r}" if c < 1 else "1"
    return Plan(f"CASE WHEN length({t}) < 8 THEN 0 WHEN {q.has('s', '^([a-fA-F0-9]{32}|[a-fA-F0-9]{64})$')} THEN 1 WHEN b THEN 0.9 WHEN u THEN 0.8 WHEN m >= 64 THEN 1 WHEN m >= 32 THEN 0.9 WHEN m >= 16 THEN 0.7 WHEN m > 0 THEN 0.5 WHEN r >= {q.num(c)} THEN {ratio} ELSE 0 END", steps)


@cache
def mojibake_patterns() -> list[str]:
    """What the UTF-8 bytes of MOJIBAKE_OF look like when read as windows-1252 or latin-1."""
    out = []
    for c in T.MOJIBAKE_OF:
        for code in ("cp1252", "latin-1"):
            try:
                out.append(c.encode().decode(code))
            except UnicodeDecodeError:
                continue
    return list(dict.fromkeys(out))


@cache
def _followers() -> str:
    return r"\x{80}-\x{C1}\x{C4}-\x{CF}\x{D2}-\x{E1}\x{E3}-\x{FF}" + ranges(p for p in range(0x100, 0xFFFE) if unicodedata.category(chr(p))[0] in "PS")


#: Traces of text that was wrongly decoded twice.
DOUBLE_ENCODED = "Ã\x83Â|Ã\x82Â|ÃƒÂ|Ã‚Â"


@scorer("mojibake", (least("pattern_threshold", 1), within("ratio_threshold")), pattern_threshold=1, ratio_threshold=0.05, check_replacement_char=True)
def _mojibake(q, t, lex, p):
    leads = "ÂÃÐÑâ"
    some = "|".join(re.escape(x) for x in sorted(mojibake_patterns(), key=lambda x: (-len(x), x)))
    steps = [
        ("n", f"CAST(length({t}) AS BIGINT)"),
        ("odd", q.has(t, r"[\x{80}-\x{9F}ÂÃÐÑâ]")),
        ("k", f"CASE WHEN odd THEN {q.size(q.find(t, some))} ELSE 0 END"),
        ("f", q.count(t, "�")),
        ("c", f"CASE WHEN odd THEN {q.size(q.find(t, r'[\x{80}-\x{9F}]'))} + 2 * {lengths(q, q.find(t, f'[{leads}]+[{_followers()}]?'), -1)} ELSE 0 END"),
        ("r", q.ratio("least(c, n)", "n")),
        ("twice", f"CASE WHEN {q.has(t, DOUBLE_ENCODED)} THEN CAST(0.95 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"),
    ]
    marks = "CASE WHEN f > 0 THEN least(CAST(1 AS DOUBLE), 0.8 + 0.05 * f) ELSE CAST(0 AS DOUBLE) END" if p["check_replacement_char"] else "CAST(0 AS DOUBLE)"
    return Plan(f"CASE WHEN n < 3 THEN 0 ELSE greatest(CASE WHEN k >= {p['pattern_threshold']} THEN least(CAST(1 AS DOUBLE), 0.7 + 0.1 * k) ELSE CAST(0 AS DOUBLE) END, {marks}, CASE WHEN r >= {q.num(p['ratio_threshold'])} THEN least(CAST(1 AS DOUBLE), 5 * r) ELSE CAST(0 AS DOUBLE) END, twice) END", steps)


@cache
def scripts() -> dict[str, str]:
    """Regex class bodies of the letters of each script, by the names of the characters."""
    prefixes = {"LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek", "ARABIC": "arabic", "HEBREW": "hebrew", "CJK": "cjk", "HANGUL": "cjk", "HIRAGANA": "cjk", "KATAKANA": "cjk"}
    found: dict[str, set] = {}
    for point in range(0x32000):
        c = chr(point)
        if c.isalpha():
            name = unicodedata.name(c, "")
            for prefix, script in prefixes.items():
                if name.startswith(prefix):
                    found.setdefault(script, set()).add(point)
    return {k: ranges(v) for k, v in found.items()}


@scorer("unicode_script", (least("homoglyph_threshold", 1), least("max_scripts", 1)), homoglyph_threshold=1, max_scripts=2, check_homoglyphs=True)
def _scripts(q, t, lex, p):
    count = lambda x: " + ".join(f"CASE WHEN {q.has(x, f'[{v}]')} THEN 1 ELSE 0 END" for v in scripts().values())
    foreign = f"[{''.join(v for k, v in scripts().items() if k != 'latin')}]"
    m = p["max_scripts"]
    steps = [
        ("odd", q.has(t, foreign)),
        ("mixed", f"CASE WHEN odd THEN {q.where(q.tokens(t), lambda x: f'{q.has(x, foreign)} AND ({count(x)}) > 1')} ELSE {'[]::VARCHAR[]' if q.duck else 'CAST(array() AS ARRAY<STRING>)'} END"),
        ("k", q.size("mixed")),
        ("h", q.total(q.transform("mixed", lambda x: f"CAST(length({q.swap(x, f'[^{T.HOMOGLYPHS}]')}) AS BIGINT)")) if p["check_homoglyphs"] else "0"),
        ("s", f"CASE WHEN odd THEN {count(t)} ELSE 1 END"),
    ]
    parts = (
        f"CASE WHEN h >= {p['homoglyph_threshold']} THEN least(CAST(1 AS DOUBLE), 0.8 + 0.05 * h) ELSE CAST(0 AS DOUBLE) END",
        "CASE WHEN k > 0 THEN least(CAST(1 AS DOUBLE), 0.7 + 0.15 * k) ELSE CAST(0 AS DOUBLE) END",
        f"CASE WHEN s > {m} THEN least(CAST(1 AS DOUBLE), 0.5 + 0.2 * (s - {m})) ELSE CAST(0 AS DOUBLE) END",
    )
    return Plan(f"CASE WHEN length({letters(q, t)}) < 2 THEN 0 ELSE greatest({', '.join(parts)}) END", steps)
