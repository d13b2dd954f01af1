"""Search snippets."""

import bisect
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from eventscope.functions.values import column

# Words before and after a hit, and words of the fallback line.
WORDS_BEFORE = 6
WORDS_AFTER = 5
WORDS_OF_LINE = 10
LETTERS = re.compile("[a-zA-Z]+")


def _after_blanks(blanks: list[int], before: int, count: int) -> int:
    """The place right after the ``count``-th blank before ``before``; 0 if there are fewer."""
    i = bisect.bisect_left(blanks, before) - count
    return blanks[i] + 1 if i >= 0 else 0


def hits_with_words(text: str, query: str) -> list[str]:
    """Every hit with up to six words before it and five after, from left to right; a hit
    takes up where the one before ended.

    The letters that stand right before a hit belong to it. Words before it count only if
    those letters begin a word. Of the hits that are in reach, the stretch begins as far
    left as one of them allows, and goes with the last one that is at most six words on.
    """
    blanks = [m.start() for m in re.finditer(" ", text)]
    runs = [m.span() for m in LETTERS.finditer(text)]
    run_starts = [r[0] for r in runs]
    found, at = [], text.find(query)
    while at >= 0:
        found.append(at)
        at = text.find(query, at + 1)
    if not found:
        return []

    def letters_before(q: int) -> int:
        i = bisect.bisect_left(run_starts, q) - 1
        return runs[i][0] if i >= 0 and runs[i][1] >= q else q

    # The letter run before each hit, and whether it begins a word: hits of one run are kin.
    heads = [letters_before(q) for q in found]
    word = [a > 0 and text[a - 1] == " " for a in heads]
    far = [_after_blanks(blanks, a, WORDS_BEFORE + 1) if w else a for a, w in zip(heads, word)]
    # The last hit with the same letters before it, and the first of each at a word.
    last = list(range(len(found)))
    for k in range(len(found) - 2, -1, -1):
        if heads[k] == heads[k + 1]:
            last[k] = last[k + 1]
    at_word = [k for k in range(len(found)) if word[k] and (k == 0 or heads[k - 1] != heads[k])]

    def words_between(start: int, head: int) -> int:
        return bisect.bisect_left(blanks, head) - bisect.bisect_left(blanks, start)

    out, done, i = [], 0, 0
    while i < len(found):
        if found[i] < done:
            i += 1
            continue
        # Where the stretch begins: of the hits behind, only those at a word can move it.
        start = max(done, far[i])
        first = past = bisect.bisect_right(at_word, i)
        while past < len(at_word) and words_between(start, heads[at_word[past]]) <= WORDS_BEFORE:
            start = min(start, max(done, far[at_word[past]]))
            past += 1
        # The hit it goes with: the last at a word that six words reach, else this one.
        best = last[i]
        for k in at_word[first:past]:
            if words_between(start, heads[k]) <= WORDS_BEFORE:
                best = last[k]
        end = found[best] + len(query)
        run = LETTERS.match(text, end)
        end = run.end() if run else end
        if text[end : end + 1] == " ":
            n = bisect.bisect_left(blanks, end) + WORDS_AFTER
            end = blanks[n] if n < len(blanks) else len(text)
        out.append(text[start:end])
        done, i = end, best + 1
    return out


def snippets(text, query: str) -> Column:
    """Every hit with the words around it, lower-cased; without a hit, the first words."""
    text = column(text)
    low, wanted = F.lower(text), query.lower()

    @F.pandas_udf("array<string>")
    def hits_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hits_with_words(t, wanted))

    hits = hits_of(low)
    first_words = F.regexp_extract(text, r"^(([^ ]* ){0,%d})" % WORDS_OF_LINE, 1)
    return F.when(
        low.contains(query.lower()), F.transform(hits, lambda hit: F.concat(F.lit("..."), hit))
    ).otherwise(F.array(first_words))
