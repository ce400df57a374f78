"""Title similarity: 200 * LCS / (len a + len b), rounded to a whole percent.

The longest common subsequence uses the bit-vector recurrence of Hyyro (2004):
one AND, one addition and one AND-NOT per character of the second string, on
as many 62-bit words as the first string needs, with a carry between them. These
are plain higher-order functions, so the work stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 62


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _words(text: Column) -> Column:
    """Numbers of the 62-bit words that the text's positions take."""
    return F.sequence(F.lit(0), F.call_function("div", F.greatest(F.length(text) - 1, F.lit(0)), F.lit(_WORD)).cast("int"))


def char_masks(text: Column) -> Column:
    """Map from each character to the bit sets of its positions, one for every 62 of them."""
    letters = chars(text)

    def masks(c: Column) -> Column:
        def word(w: Column) -> Column:
            part = F.slice(letters, w * _WORD + 1, F.lit(_WORD))
            return F.aggregate(
                F.transform(part, lambda d, i: F.when(d == c, _bit(i)).otherwise(_long(0))),
                _long(0),
                lambda acc, bit: acc.bitwiseOR(bit),
            )

        return F.transform(_words(text), word)

    entry = lambda c: F.struct(c.alias("key"), masks(c).alias("value"))
    return F.map_from_entries(F.transform(F.array_distinct(letters), entry))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", _long(1), position.cast("int"))


_FULL = (1 << _WORD) - 1


def lcs_length(a: Column, masks_a: Column, b: Column) -> Column:
    """LCS length of ``a`` and ``b``; ``masks_a`` is ``char_masks(a)``.

    The words of the state are updated from the lowest up; each hands its carry to the next.
    """
    one = F.when(F.length(a) <= _WORD, _lcs_word(a, masks_a, b))
    return F.coalesce(one, _lcs_words(a, masks_a, b))


def _lcs_word(a: Column, masks_a: Column, b: Column) -> Column:
    full = _bit(F.length(a)) - _long(1)

    def step(v: Column, c: Column) -> Column:
        m = F.coalesce(F.get(F.try_element_at(masks_a, c), F.lit(0)), _long(0))
        hit, miss = v.bitwiseAND(m), v.bitwiseAND(F.bitwise_not(m))
        return (v + hit).bitwiseOR(miss).bitwiseAND(full)

    return (F.length(a) - F.bit_count(F.aggregate(chars(b), full, step))).cast("int")


def _lcs_words(a: Column, masks_a: Column, b: Column) -> Column:
    words = _words(a)
    none = F.transform(words, lambda w: _long(0))

    def step(state: Column, c: Column) -> Column:
        masks = F.coalesce(F.try_element_at(masks_a, c), none)

        def word(acc: Column, w: Column) -> Column:
            v, m = F.get(state, w), F.get(masks, w)
            added = v + v.bitwiseAND(m) + acc["carry"]
            new = added.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(_long(_FULL))
            return F.struct(
                F.call_function("shiftright", added, F.lit(_WORD)).alias("carry"),
                F.concat(acc["state"], F.array(new)).alias("state"),
            )

        start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("state"))
        return F.aggregate(words, start, word, lambda acc: acc["state"])

    full = F.transform(words, lambda w: _long(_FULL))
    state = F.aggregate(chars(b), full, step)
    # Positions beyond the text never match, so their bits stay set.
    zeros = F.aggregate(state, F.lit(0), lambda acc, v: acc + (_WORD - F.bit_count(v)))
    return zeros.cast("int")


# --- bags of characters ------------------------------------------------------

def _signature(classes: Column, words: int, bits: int) -> list[Column]:
    """How often each class occurs, up to ``bits`` times, in unary: ``words`` 64-bit numbers."""
    in_word = 64 // bits

    def count(n: int) -> Column:
        found = F.least(F.size(F.filter(classes, lambda x: x == n)), F.lit(bits))
        unary = _bit(found) - _long(1)
        return F.call_function("shiftleft", unary, F.lit(bits * (n % in_word)))

    out = []
    for w in range(words):
        word = _long(0)
        for n in range(w * in_word, (w + 1) * in_word):
            word = word.bitwiseOR(count(n))
        out.append(word)
    return out


def bag_classes(text: Column) -> Column:
    return F.transform(chars(text), lambda c: F.ascii(c).bitwiseAND(F.lit(31)))


def bag(classes: Column) -> list[Column]:
    """Four numbers: how often characters of 32 classes occur, up to 8 times each.

    ``classes`` is a column of ``bag_classes``. The bits in which two bags differ are no more than the
    characters that one text has and the other lacks, so they bound the insertions and deletions
    between the texts from below.
    """
    return _signature(classes, 4, 8)


def pair_classes(text: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.transform(pairs, lambda p: F.pmod(F.hash(p), F.lit(64)))


def pair_bag(classes: Column) -> list[Column]:
    """Four numbers: how often neighbouring characters of 64 classes occur, up to 4 times each.

    ``classes`` is a column of ``pair_classes``. An insertion or deletion changes three pairs at most.
    """
    return _signature(classes, 4, 4)


def bag_distance(a: list[Column], b: list[Column]) -> Column:
    found = F.lit(0)
    for x, y in zip(a, b, strict=True):
        found = found + F.bit_count(x.bitwiseXOR(y))
    return found


# --- thresholds --------------------------------------------------------------


def least_common(total_length: Column, threshold: float) -> Column:
    """The least LCS length with which texts of that total length reach the threshold."""
    m = min_percent(threshold)
    need = total_length * (2 * m - 1)
    rounded = (need + 399) if m % 2 == 0 else (need + 400)
    return F.call_function("div", rounded.cast("bigint"), _long(400)).cast("int")


def most_edits(total_length: Column, threshold: float) -> Column:
    """Insertions and deletions that texts of that total length may be apart."""
    return total_length - 2 * least_common(total_length, threshold)


def min_percent(threshold: float) -> int:
    """Smallest whole percent that reaches ``threshold`` (0..1)."""
    scaled = threshold * 100
    return int(scaled) if scaled == int(scaled) else int(scaled) + 1


def reaches(lcs: Column, total_length: Column, threshold: float) -> Column:
    """round_half_even(200 * lcs / total) >= threshold * 100, in whole numbers.

    The rounded percent is >= m exactly when 400*lcs exceeds (2m-1)*total, or
    equals it and m is even. Two empty strings are alike.
    """
    m = min_percent(threshold)
    left, right = lcs * 400, total_length * (2 * m - 1)
    hit = (left >= right) if m % 2 == 0 else (left > right)
    return F.when(total_length == 0, True).otherwise(hit)
