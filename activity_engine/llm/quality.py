"""Line-first cleaning (operator 7).

Every line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses too large a share of its
word characters is rejected. Whole-document base signals are counted beside it.

Defined cases: a null text has no words and counts 0 everywhere (base_failed,
since it has fewer than 10 words); each input row gives one row, repeated rows
and null ids included; a column that clashes with a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import SPACES, append, buffer, mixed, pieces, separators, split, window_hash, window_starts

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lost_share double, cleaned_text string"
)
SYMBOLS = separators("#*$%&|<>")
NEWLINE = separators("\n")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict.

    navigation: a line of at most ``navigation_words`` words without sentence
    punctuation that holds a menu separator or a menu phrase, or a line in
    which separators stand between most words.
    boilerplate: a line that holds one of ``boilerplate``.
    punctuation: a line with a word but without letters, or in which over
    ``max_symbol_share`` of the characters are ASCII symbols.
    """

    navigation_words: int = 12
    navigation: str = r"(?i)^\s*(home|menu|login|log in|sign in|sign up|search|next|previous|share|read more)\s*$|\S\s*[|»›]\s*\S.*\s[|»›]\s"
    boilerplate: str = (
        r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
        r"|lorem ipsum|enable javascript|javascript is disabled|subscribe to our newsletter"
    )
    max_symbol_share: float = 0.3
    max_lost_share: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5


def line_failures(lines: pa.Array, words: np.ndarray, rules: Rules) -> np.ndarray:
    """Of the given distinct lines, those that a rule removes."""
    chars = np.maximum(np.asarray(pc.utf8_length(lines)), 1)
    symbols = chars - np.asarray(pc.utf8_length(pc.replace_substring_regex(lines, "[!-/:-@\\[-`{-~]", "")))
    ends = np.asarray(pc.match_substring_regex(lines, r"[.!?…:;\"'”»)]\s*$"))
    menu = np.asarray(pc.match_substring_regex(lines, rules.navigation))
    bars = np.asarray(pc.count_substring_regex(lines, r"\s[|»›]\s")) * 2 >= np.maximum(words - 1, 1)
    letters = np.asarray(pc.match_substring_regex(lines, r"\pL"))
    navigation = menu & ~ends & (words <= rules.navigation_words) | bars & (words > 2)
    boilerplate = np.asarray(pc.match_substring_regex(lines, rules.boilerplate))
    punctuation = ~letters | (symbols > rules.max_symbol_share * chars)
    return (words > 0) & (navigation | boilerplate | punctuation)


def signals(part: pa.RecordBatch, column: str, rules: Rules) -> dict:
    data, offsets = buffer(part.column(column))
    n = len(offsets) - 1
    words = split(data, offsets, SPACES)
    of = words.of_text()
    n_words = np.diff(words.first)

    def summed(flags: np.ndarray, cuts: np.ndarray = offsets) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[cuts[1:]] - total[cuts[:-1]]

    letters = (data & 0xC0) != 0x80
    solid = letters & ~SPACES[data]
    # repeated windows: equal hashes of codes within one text
    at = window_starts(words, rules.repeat_window)
    seed = mixed(of.astype(np.uint64) + np.uint64(1))
    codes = mixed(words.codes.astype(np.uint64) + np.uint64(11))
    hashes = window_hash(codes, at, rules.repeat_window) ^ seed[at]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(of) + 1, np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + rules.repeat_window, -1)
    repeats = summed(np.cumsum(delta[:-1]) > 0, words.first)
    # lines: between newlines of one text; an empty line has no piece here and no word either
    lines = split(data, offsets, NEWLINE)
    line_of = lines.of_text()
    word_edge = np.zeros(len(data) + 1, np.int64)
    word_edge[words.starts + 1] = 1
    begun = np.cumsum(word_edge)
    line_words = begun[lines.stops] - begun[lines.starts]
    solid_sum = np.append(0, np.cumsum(solid, dtype=np.int64))
    line_chars = solid_sum[lines.stops] - solid_sum[lines.starts]
    key = line_of.astype(np.int64) * max(1, len(lines.distinct)) + lines.codes
    real = line_words > 0
    distinct_lines = np.bincount(np.unique(key[real]) // max(1, len(lines.distinct)), minlength=n)
    n_dup = np.bincount(line_of[real], minlength=n) - distinct_lines
    # rules are evaluated once for each distinct line
    some = np.unique(lines.codes, return_index=True)
    failing = np.zeros(max(1, len(lines.distinct)), bool)
    if len(some[0]):
        failing[some[0]] = line_failures(lines.distinct.take(pa.array(some[0])), line_words[some[1]], rules)
    removed = failing[lines.codes]
    word_chars = summed(solid)
    lost = np.bincount(line_of, weights=line_chars * removed, minlength=n)
    lost_share = np.where(word_chars > 0, lost / np.maximum(word_chars, 1), 0.0)
    base_failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
    # the cleaned text: the bytes of failing lines go, with the newline behind them
    gone = np.zeros(len(data) + 1, np.int64)
    gone[lines.starts[removed]] += 1
    stops = lines.stops[removed]
    behind = (stops < len(data)) & (np.append(data, 0)[stops] == 10) & (stops < offsets[1:][line_of[removed]])
    np.add.at(gone, stops + behind, -1)
    keep = np.cumsum(gone[:-1]) == 0
    cleaned = pieces_of(data[keep], np.append(0, np.cumsum(keep))[offsets])
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": summed(SYMBOLS[data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost_share <= rules.max_lost_share),
        "lost_share": lost_share,
        "cleaned_text": cleaned,
    }


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pieces(np.ascontiguousarray(data), offsets[:-1])


def clean_lines(docs: DataFrame, column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the columns of FIELDS, one row for each row."""
    return append(docs, column, FIELDS, lambda part: signals(part, column, rules))
