"""Word stems as column expressions, from tables of endings.

The Russian stemmer is the Snowball algorithm: endings are looked for in the part of a
word after its first vowel, the longest one first. A rule is a regular expression that
ends in ``$`` and keeps its first group, so the same table serves other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import let

_V = fixed.RUSSIAN_VOWELS


def _either(endings: str) -> str:
    return "|".join(sorted(endings.split(), key=len, reverse=True))


def _rule(after_a: str, always: str) -> str:
    """Endings that must follow one of two letters, which stays, and endings that need nothing."""
    return f"(?:([ая])(?:{_either(after_a)})|(?:{_either(always)}))$"


GERUND = _rule(fixed.RUSSIAN_GERUNDS_AFTER_A, fixed.RUSSIAN_GERUNDS)
REFLEXIVE = f"()(?:{_either(fixed.RUSSIAN_REFLEXIVES)})$"
ADJECTIVAL = _rule(fixed.RUSSIAN_PARTICIPLES_AFTER_A, fixed.RUSSIAN_PARTICIPLES)[:-1] + f"?(?:{_either(fixed.RUSSIAN_ADJECTIVES)})$"
VERB = _rule(fixed.RUSSIAN_VERBS_AFTER_A, fixed.RUSSIAN_VERBS)
NOUN = f"()(?:{_either(fixed.RUSSIAN_NOUNS)})$"
LAST_I = "()и$"
DERIVATIONAL = "()(?:ость|ост)$"
SUPERLATIVE = "()(?:ейше|ейш)$"
DOUBLE_N = "(н)н$"
SOFT_SIGN = "()ь$"
#: Up to and with the first vowel; up to the second region.
HEAD = f"^[^{_V}]*[{_V}]"
SECOND = f"^[^{_V}]*[{_V}]+[^{_V}][^{_V}]*[{_V}]+[^{_V}]"


def _cut(word: Column, rule: str) -> Column:
    return F.regexp_replace(word, rule, "$1")


def _first_cut(word: Column, rule: str, *others: str) -> Column:
    """The word after the first rule that changes it."""
    otherwise = _first_cut(word, *others) if others else word
    return let(_cut(word, rule), lambda cut: F.when(cut != word, cut).otherwise(otherwise))


def _flexions(rest: Column) -> Column:
    """Without the ending of a gerund, or of a reflexive and an adjective, verb or noun; then without a last и."""
    plain = let(_cut(rest, REFLEXIVE), lambda r: _first_cut(r, ADJECTIVAL, VERB, NOUN))
    return _cut(let(_cut(rest, GERUND), lambda g: F.when(g != rest, g).otherwise(plain)), LAST_I)


def _tidied(rest: Column) -> Column:
    """One of: a double н made single, a superlative ending off (and н made single), a soft sign off."""
    superlative = let(_cut(rest, SUPERLATIVE), lambda s: F.when(s != rest, _cut(s, DOUBLE_N)).otherwise(_cut(rest, SOFT_SIGN)))
    return let(_cut(rest, DOUBLE_N), lambda n: F.when(n != rest, n).otherwise(superlative))


def russian_stem(word: Column) -> Column:
    """The stem of a small-letter word; words without a Russian vowel, and null, stay as they are."""

    def stemmed(w: Column) -> Column:
        head = F.regexp_extract(w, HEAD, 0)
        second = F.length(F.regexp_extract(w, SECOND, 0))

        def derived(h: Column, rest: Column) -> Column:
            whole = F.concat(h, _cut(rest, DERIVATIONAL))
            return F.when((second > 0) & (F.length(whole) >= second), _cut(rest, DERIVATIONAL)).otherwise(rest)

        def joined(h: Column) -> Column:
            flexed = let(F.substr(w, F.length(h) + 1), _flexions)
            return F.concat(h, let(let(flexed, lambda rest: derived(h, rest)), _tidied))

        return F.when(F.length(head) > 0, let(head, joined)).otherwise(w)

    return let(F.replace(word, F.lit("ё"), F.lit("е")), stemmed)
