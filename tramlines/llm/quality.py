"""Line-first cleaning: judge every line, drop those that fail, then judge the document.

Line rules, each a reason to remove the line:

* ``navigation``: at least `max_separators` menu separators (``|``, ``>``, ``»``, ``•``, ``·``) and
  more than one of them for every four words;
* ``boilerplate``: one of `phrases` (ASCII case ignored) in a line of at most `phrase_words` words;
* ``symbols``: more than `max_symbol_ratio` characters of ``#*$%&|<>`` per word;
* ``shouting``: of the ASCII letters, at least `min_letters`, more than `max_upper` are capitals;
* ``repeated``: equal to an earlier line of the document;
* ``stutter``: over half of the words lie in 3-word windows seen twice in the document;
* ``punctuation``: `open_words` words or more and no closing punctuation at the end.

A document is rejected if removed lines hold more than `max_lost` of its words.

Edge cases: a null or empty text has no words or lines, fails the base rules and is not kept; a
text of one very long line is one line; repeated rows are judged each on its own; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as X

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line and document rules; see the module text."""

    min_words: int = 50
    max_repeat: int = 50
    max_separators: int = 3
    phrases: tuple[str, ...] = (
        "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
        "enable javascript", "sign in", "log in", "sign up", "subscribe to our", "read more", "click here",
        "skip to content", "powered by", "share this", "lorem ipsum",
    )
    phrase_words: int = 12
    max_symbol_ratio: float = 0.3
    max_upper: float = 0.6
    min_letters: int = 20
    open_words: int = 4
    max_lost: float = 0.5


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_kept long, clean_text string"
)


def _find_all(haystack: bytes, needle: bytes) -> list[int]:
    out, at = [], haystack.find(needle)
    while at >= 0:
        out.append(at)
        at = haystack.find(needle, at + 1)
    return out


def _repeated(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it seen twice or more in its text; is it there before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(X.mix(keys + X.mix(text.astype(np.uint64))), kind="stable")
    k, t = keys[order], text[order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    later = np.zeros(len(keys), bool)
    twice = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def judge(data: np.ndarray, offs: np.ndarray, rules: LineRules) -> dict[str, np.ndarray | list]:
    """All figures of a slice of texts; see SCHEMA."""
    n = len(offs) - 1
    prefix = X.prefix_hashes(data)
    ws, we, wb = X.word_spans(data, offs)
    n_words = np.diff(wb)
    text_of_word = np.repeat(np.arange(n), n_words)
    lead = (data & 0xC0) != 0x80
    white = X._WHITE[data]
    word_chars = X.per_text(lead & ~white, offs)
    n_symbols = X.per_text(_SYMBOL[data], offs)

    keys, at = X.window_hashes(X.span_hashes(prefix, ws, we), wb, 3)
    twice, _ = _repeated(keys, text_of_word[at])
    covered = np.zeros(len(ws) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    covered = covered[: len(ws)]
    n_repeat = X.per_text(covered, wb)

    cuts = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offs[:-1], cuts + 1]))
    begins = begins[begins < len(data)]
    # A newline at the very end of a text opens a line without words; it belongs to no text's rules.
    text_of_line = np.searchsorted(offs, begins, side="right") - 1
    ends = np.empty_like(begins)
    ends[:-1], ends[-1:] = begins[1:], len(data)
    body_end = np.minimum(ends, offs[1:][text_of_line]) if len(begins) else ends
    body_end = np.where((body_end > begins) & (data[np.maximum(body_end - 1, 0)] == 10), body_end - 1, body_end) if len(begins) else ends
    first_word = np.searchsorted(ws, begins)
    line_words = np.searchsorted(ws, body_end) - first_word
    real = line_words > 0
    line_hash = X.span_hashes(prefix, begins, body_end)
    later = np.zeros(len(begins), bool)
    later[real] = _repeated(line_hash[real], text_of_line[real])[1]
    n_dup = np.bincount(text_of_line[later], minlength=n) if len(begins) else np.zeros(n, np.int64)

    span = lambda flags: X.per_text(flags, np.append(begins, len(data))) if len(begins) else np.zeros(0, np.int64)
    separators = span((data == ord("|")) | (data == ord(">")))
    raw = data.tobytes()
    for mark in ("»", "•", "·"):
        for p in _find_all(raw, mark.encode()):
            separators[np.searchsorted(begins, p, side="right") - 1] += 1
    letters, upper = span(_LETTER[data]), span(_UPPER[data])
    last = we[np.maximum(first_word + line_words - 1, 0)] - 1 if len(ws) else np.zeros(len(begins), np.int64)
    closing = np.isin(data[last], np.frombuffer(b".!?:;\"')]", np.uint8)) if len(ws) else np.zeros(len(begins), bool)
    if len(ws):  # closing marks of more than one byte: the ellipsis, right quotes, ideographic full stop
        three = np.stack([data[np.maximum(last - j, 0)] for j in (2, 1, 0)], 1).astype(np.int64) @ np.array([65536, 256, 1])
        closing |= np.isin(three, [int.from_bytes(c.encode(), "big") for c in "…”’。！？"])
        closing |= (data[np.maximum(last - 1, 0)] == 0xC2) & (data[last] == 0xBB)
    boiler = np.zeros(len(begins), bool)
    low = X.lower_ascii(data).tobytes()
    for phrase in rules.phrases:
        for p in _find_all(low, phrase.encode()):
            line = np.searchsorted(begins, p, side="right") - 1
            boiler[line] |= bool(p + len(phrase.encode()) <= body_end[line] and line_words[line] <= rules.phrase_words)
    run = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(covered, out=run[1:])
    stutter = 2 * (run[first_word + line_words] - run[first_word]) > line_words
    removed = real & (
        ((separators >= rules.max_separators) & (4 * separators > line_words))
        | boiler
        | (span(_SYMBOL[data]) > rules.max_symbol_ratio * line_words)
        | ((letters >= rules.min_letters) & (upper > rules.max_upper * letters))
        | later
        | stutter
        | ((line_words >= rules.open_words) & ~closing)
    )
    kept_words = np.bincount(text_of_line, line_words * ~removed, n).astype(np.int64) if len(begins) else np.zeros(n, np.int64)
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat * n_words)
    lost = n_words - kept_words
    clean, by_text = [], np.searchsorted(text_of_line, np.arange(n + 1))
    for i in range(n):
        a, b = by_text[i], by_text[i + 1]
        if not removed[a:b].any():
            clean.append(raw[offs[i] : offs[i + 1]])
        else:
            clean.append(b"\n".join(raw[begins[j] : body_end[j]] for j in range(a, b) if not removed[j]))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & (lost <= rules.max_lost * n_words),
        "n_lines": np.bincount(text_of_line[real], minlength=n) if len(begins) else np.zeros(n, np.int64),
        "n_lines_removed": np.bincount(text_of_line[removed], minlength=n) if len(begins) else np.zeros(n, np.int64),
        "n_words_kept": kept_words, "clean_text": clean,
    }


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document with the base figures, the verdict and the text without failed lines.

    A map over rows: no shuffle, memory bounded by a slice of texts or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                out = judge(data, offs, rules)
                cols = [batch.column(0).slice(a, b - a)]
                for name, values in out.items():
                    if name == "clean_text":
                        cols.append(pa.array(values, pa.binary()).cast(pa.string()))
                    elif name in ("base_failed", "kept"):
                        cols.append(pa.array(values.astype(bool)))
                    else:
                        cols.append(pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *out])

    return X.documents_of(docs).mapInArrow(run, SCHEMA)
