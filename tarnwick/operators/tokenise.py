"""Tokens of texts by whole Arrow batches: each distinct token of a slice is cleaned and looked up once.

The cleaners are those of functions.columns; a slice of texts becomes numpy columns, so counts leave a task
summed and no row is made for a token unless tokens are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that are cut into tokens at a time, about.
SLICE = 4 << 20
#: Words of a vocabulary up to which it is broadcast, 12 bytes each; with more, tokens meet it in a join.
BROADCAST_WORDS = 24_000_000


@dataclass
class Tokens:
    """Of each token: the row of its text, line, place in the line, and index of its word in words."""

    row: np.ndarray
    line: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    words: pa.Array


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _tokens(texts: pa.Array, blank: Callable, pattern: str, by: str, places_of_all: bool) -> Tokens:
    lists = pc.split_pattern(texts, "\n")
    n = _lengths(lists)
    lines, row, line = lists.flatten(), np.repeat(np.arange(len(n)), n), _places(n)
    some = blank(lines)
    lines = lines.filter(some)
    some = some.to_numpy(zero_copy_only=False)
    row, line = row[some], line[some]
    lists = pc.split_pattern(lines, " ")
    n = _lengths(lists)
    raw = lists.flatten().dictionary_encode()
    clean = pc.ascii_lower(pc.utf8_trim(pc.replace_substring_regex(raw.dictionary, pattern, by), " ")).dictionary_encode()
    code = clean.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)] if len(raw) else np.zeros(0, np.int64)
    of, pos, words = np.repeat(np.arange(len(n)), n), _places(n), clean.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        kept = code != empty
        of, pos, code = of[kept], pos[kept], code[kept]
        if not places_of_all:
            pos = _places(np.bincount(of, minlength=len(n)))
    return Tokens(row[of], line[of].astype(np.int32), pos.astype(np.int32), code, words)


def topic(texts: pa.Array) -> Tokens:
    """Tokens by the topic model's cleaner; dropped ones keep their places, and blank lines have none."""
    return _tokens(texts, lambda x: pc.match_substring_regex(x, "[^ ]"), "[^A-Z^a-z]", " ", True)


def embedding(texts: pa.Array) -> Tokens:
    """Tokens by the embedding cleaner; places count the tokens that stay."""
    return _tokens(texts, lambda x: pc.greater(pc.binary_length(x), 0), "[^a-zA-Z ]", "", False)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


Cleaner = Callable[[pa.Array], Tokens]
Make = Callable[[pa.Array, Tokens, np.ndarray | None], list]


def mapped(docs: DataFrame, cleaner: Cleaner, make: Make, schema: str, names: list[str], lookup=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What make(ids, tokens, word ids) gives for slices of the texts, as columns; with a lookup, words outside it are dropped.

    schema may name the type of the ids as {id}.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                t, ids = cleaner(part.column(1)), None
                if lookup is not None:
                    ids = found(lookup.value, t.words)[t.code]
                    if (ids < 0).any():
                        k = ids >= 0
                        t, ids = Tokens(t.row[k], t.line[k], t.pos[k], t.code[k], t.words), ids[k]
                if len(t.code):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in make(part.column(0), t, ids)], names)

    return own.mapInArrow(run, schema.format(id=own.schema["doc_id"].dataType.simpleString()))


# ---------------------------------------------------------------- vocabularies


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def found(table: tuple[np.ndarray, np.ndarray], words: pa.Array) -> np.ndarray:
    """The id of each word, -1 where the table has none."""
    known, ids = table
    h = _hashes(words)
    if not len(known):
        return np.full(len(h), -1, np.int32)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, ids[at], np.int32(-1))


def lookup(vocabulary: DataFrame, whole: bool, most: int | None = None):
    """A broadcast table of hashes and ids of (word, id), or None if the words are too many or two share a hash.

    whole: the vocabulary has each word that will be looked up, so hashes that differ tell words apart.  Otherwise
    the words outside it could share a hash with one in it, and a join is the exact way.
    """
    if not whole or vocabulary.count() > (BROADCAST_WORDS if most is None else most):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(0)).view(np.int64)), b.column(1)], ["h", "id"])

    rows = vocabulary.select("word", F.col("id").cast("int").alias("id")).mapInArrow(run, "h long, id int").toArrow()
    h, ids = rows.column("h").to_numpy().view(np.uint64), rows.column("id").to_numpy()
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    if (h[1:] == h[:-1]).any():
        return None
    return vocabulary.sparkSession.sparkContext.broadcast((h, ids))


# ---------------------------------------------------------------- what leaves a slice


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows of keys, whole numbers from 0, and how often each comes)."""
    code = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        code = code * (int(k.max()) + 1) + k
    code, n = np.unique(code, return_counts=True)
    out = []
    for k in keys[::-1]:
        code, own = np.divmod(code, int(k.max()) + 1)
        out.append(own)
    return out[::-1], n


def all_tokens(ids: pa.Array, t: Tokens, _) -> list:
    return [ids.take(pa.array(t.row)), t.line, t.pos, t.words.take(pa.array(t.code))]


def word_totals(_ids: pa.Array, t: Tokens, _) -> list:
    n = np.bincount(t.code, minlength=len(t.words))
    some = np.flatnonzero(n)
    return [t.words.take(pa.array(some)), n[some]]


def text_words(ids: pa.Array, t: Tokens, _) -> list:
    (row, code), n = _counted(t.row, t.code)
    return [ids.take(pa.array(row)), t.words.take(pa.array(code)), n]


def window_pairs(window: int) -> Make:
    """(least, greatest, n): how often two words stand at most window places apart in a line, whichever comes first."""

    def make(_ids: pa.Array, t: Tokens, _) -> list:
        rank = np.empty(len(t.words), np.int64)
        by = pc.array_sort_indices(t.words).to_numpy()
        rank[by] = np.arange(len(by))
        code = rank[t.code]
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, window + 1):
            near = np.flatnonzero((t.row[d:] == t.row[:-d]) & (t.line[d:] == t.line[:-d]) & (t.pos[d:] - t.pos[:-d] <= window))
            a, b = code[near], code[near + d]
            low.append(np.minimum(a, b))
            high.append(np.maximum(a, b))
        if not sum(map(len, low)):
            return [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())]
        (a, b), n = _counted(np.concatenate(low), np.concatenate(high))
        return [t.words.take(pa.array(by[a])), t.words.take(pa.array(by[b])), n]

    return make


# ---------------------------------------------------------------- first topics

#: What sets the lines of a text apart in the places of the topic model's tokens.
LINE = 100_000


def _topic(ids: pa.Array, t: Tokens, word: np.ndarray, k: int) -> np.ndarray:
    """The first topic of each token, as topics.assign_topics has it; k where the text has no id."""
    doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    topic = (doc[t.row] * 31 + (t.line.astype(np.int64) * LINE + t.pos) * 17 + word.astype(np.int64) * 7) % k
    if ids.null_count:
        topic[pc.is_null(ids).to_numpy(zero_copy_only=False)[t.row]] = k
    return topic


def _nullable(topic: np.ndarray, k: int) -> pa.Array:
    return pa.array(topic.astype(np.int32), mask=topic == k)


def topic_rows(k: int) -> Make:
    return lambda ids, t, word: [ids.take(pa.array(t.row)), t.line.astype(np.int64) * LINE + t.pos, word, _nullable(_topic(ids, t, word, k), k)]


def topic_totals(k: int) -> Make:
    def make(ids: pa.Array, t: Tokens, word: np.ndarray) -> list:
        (topic,), n = _counted(_topic(ids, t, word, k))
        return [_nullable(topic, k), n]

    return make


def word_topics(k: int) -> Make:
    def make(ids: pa.Array, t: Tokens, word: np.ndarray) -> list:
        (w, topic), n = _counted(word.astype(np.int64), _topic(ids, t, word, k))
        return [w.astype(np.int32), _nullable(topic, k), n]

    return make


def text_topics(k: int) -> Make:
    def make(ids: pa.Array, t: Tokens, word: np.ndarray) -> list:
        (row, topic), n = _counted(t.row, _topic(ids, t, word, k))
        return [ids.take(pa.array(row)), _nullable(topic, k), n]

    return make


def topic_documents(k: int) -> Make:
    """One row for each text that has tokens: its id, and their places, words and topics."""

    def make(ids: pa.Array, t: Tokens, word: np.ndarray) -> list:
        some, n = np.unique(t.row, return_counts=True)
        ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        lists = (t.line.astype(np.int64) * LINE + t.pos, word.astype(np.int32), _topic(ids, t, word, k).astype(np.int32))
        return [ids.take(pa.array(some)).cast(pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)]

    return make
