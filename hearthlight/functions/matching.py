"""Finding many fixed phrases in long texts with one scan per text.

Testing 200 terms one by one reads every text 200 times. Here one look-ahead expression, built as
a prefix tree of all terms, reads the text once and collects the longest term at each position.
The collected terms form a short "hit list" string on which the individual tests run: a term
occurs in the text exactly when some collected term starts with it. Where a whole frame is at hand,
an automaton makes the same list at a fraction of the time (``with_hit_list``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\n"


def quote(term: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#])", r"\\\1", term)


def prefix_tree(terms: Iterable[str]) -> str:
    """Expression that matches the longest of ``terms`` at a position."""
    tails: dict[str, list[str]] = {}
    words = set(terms)
    for word in sorted(words - {""}):
        tails.setdefault(word[0], []).append(word[1:])
    if not tails:
        return ""
    branches = [quote(head) + prefix_tree(rest) for head, rest in tails.items()]
    body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
    return f"(?:{body})?" if "" in words else body


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_letter_search(terms: Iterable[str], few: int = 3) -> str:
    """Prefix tree whose top level halves the set of first letters with look-aheads.

    A plain alternation tries every first letter at every position; halving needs only a handful
    of character-class tests, which makes the scan about a third faster.
    """
    words: dict[str, list[str]] = {}
    for term in set(terms):
        words.setdefault(term[0], []).append(term)

    def letters(heads: Sequence[str]) -> str:
        return "[" + "".join(quote(h) for h in heads) + "]"

    def build(heads: Sequence[str]) -> str:
        if len(heads) <= few:
            return "(?:" + "|".join(prefix_tree(words[h]) for h in heads) + ")"
        low, high = heads[:len(heads) // 2], heads[len(heads) // 2:]
        return f"(?:(?={letters(low)}){build(low)}|(?={letters(high)}){build(high)})"

    return build(sorted(words))


def hit_list(text: Column, terms: Iterable[str], anchor: str = "") -> Column:
    """Distinct terms found in ``text``, each preceded by a line break, as one string."""
    found = F.regexp_extract_all(text, F.lit(f"{anchor}(?=({first_letter_search(terms)}))"), 1)
    return F.concat(F.lit(SEP), F.array_join(F.array_distinct(found), SEP))


def with_hit_list(df: DataFrame, text: str, terms: Iterable[str], name: str, at_edge: bool = False
                  ) -> DataFrame:
    """Adds what ``hit_list`` finds in a text column that is never null.

    One automaton for all terms runs over Arrow batches of texts: a step a character, however many
    terms there are, where the look-ahead tree tries several classes of letters at each one. With
    ``at_edge``, terms right behind an ASCII letter, digit or underscore are left out; others may
    not be at a word's edge either, so a pattern has to follow, as for ``start_hits``.
    """
    words = sorted(set(terms))

    # Refers to nothing of this module but values, so workers need not be able to import it.
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        machine, out = ahocorasick.Automaton(), []
        for word in words:
            machine.add_word(word, word)
        machine.make_automaton()
        for body in texts:
            if at_edge:
                found = set()
                for end, term in machine.iter(body):
                    before = end - len(term)
                    if term not in found and (before < 0 or not (
                            body[before] == "_" or body[before].isascii() and body[before].isalnum())):
                        found.add(term)
            else:
                found = {term for _, term in machine.iter(body)}
            out.append(SEP + SEP.join(found))
        return pd.Series(out, dtype=object)

    return df.withColumn(name, find(F.col(text)))


def in_hits(hits: Column, term: str) -> Column:
    return F.contains(hits, F.lit(SEP + term))


def any_in_hits(hits: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [in_hits(hits, t) for t in dict.fromkeys(terms)])


def count_in_hits(hits: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [in_hits(hits, t).cast("int") for t in terms])


def any_term(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def compact(values: Sequence[Column]) -> Column:
    """Array of the non-null strings among ``values``, in order (values hold no line breaks)."""
    return F.array_remove(F.split(F.concat_ws(SEP, *values), SEP), "")


def pattern(expr: str, ignore_case: bool = False) -> str:
    """Unicode-aware form of a pattern, so word edges, digits and blanks follow the text."""
    return ("(?iU)" if ignore_case else "(?U)") + expr


def any_pattern(text: Column, patterns: Sequence[str], start: str = "") -> Column:
    """``start`` is what every match begins with; it is looked for first, since a Unicode word edge costs
    far more to test at each position than a letter."""
    found = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(pattern(f"(?={start})(?:{found})" if start else found))


def letters_first(expr: str) -> str:
    """A pattern of ``alternatives`` that looks for one of their first letters before the word's edge."""
    return f"(?=[{''.join(sorted({a[0] for a in alternatives(expr)}))}]){expr}"


def alternatives(expr: str) -> list[str]:
    """The literals of a pattern that is one group of them between word edges."""
    return [a.replace("\\", "") for a in re.fullmatch(r"\\b\((?:\?:)?(.*)\)\\b", expr).group(1).split("|")]


def literal_start(expr: str) -> str:
    """The literal characters a word-edge pattern must begin with."""
    body = expr.removeprefix(r"\b")
    head = re.match(r"[a-z' ]+", body).group(0)
    follows = body[len(head):len(head) + 1]
    return head[:-1] if follows in ("?", "*") else head


def start_first(expr: str) -> str:
    """A word-edge pattern that looks for its literal start before the word's edge."""
    return f"(?={quote(literal_start(expr))}){expr}"


def longest_literal(expr: str) -> str:
    """A literal that every match of a simple pattern must contain."""
    return max(re.split(r"\[[^\]]*\]\+|.\?", expr.replace(r"\b", "")), key=len)


def start_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Hit list of the literal starts of word-edge patterns."""
    return hit_list(text, [literal_start(p) for p in patterns], r"(?U)\b")


def any_pattern_at(text: Column, hits: Column, patterns: Sequence[str]) -> Column:
    """``any_pattern`` for word-edge patterns; each one only runs where its start occurs."""
    return reduce(lambda a, b: a | b, [
        in_hits(hits, literal_start(p)) & text.rlike(pattern(start_first(p))) for p in patterns
    ])


def pattern_hits(text: Column, hits: Column, patterns: Sequence[str]) -> list[Column]:
    """One nullable column per pattern, holding the pattern where it matches.

    ``hits`` is the hit list of the patterns' literal starts; it rules most patterns out, so the
    full expression only runs on texts that can match.
    """
    return [
        F.when(in_hits(hits, literal_start(p)) & text.rlike(pattern(start_first(p))), F.lit(p))
        for p in patterns
    ]
