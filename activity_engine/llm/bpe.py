"""BPE encoding and decoding with a lexicon automaton (operator 4).

The most frequent words of the corpus are encoded once and compiled into a
minimal acyclic transducer whose outputs are their ids. The file goes to every
executor with the job's files and is mapped into memory there. Words that it
doesn't hold are merged exactly, once per distinct word of a slice.

A word is a run of characters other than ASCII white space. The vocabulary's
normaliser turns white space into single spaces that its pattern drops, so ids
of a text are the ids of its words in turn.

Defined cases: a null or empty text has no ids and decodes to the empty text;
special tokens' strings inside texts become their ids, as the library does by
default; each input row gives one row, repeated rows and null ids included;
columns with the new names are replaced.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .lexicon import frequent, units
from .tokenizer import load
from .transducer import Transducer, build, save
from .words import append

#: Words in the automaton at most: a file of some 5 MB.
LEXICON = 131_072


def encode_words(path: str, words: list[str], step: int = 20_000) -> list[list[int]]:
    tokenizer = load(path)
    out: list[list[int]] = []
    for i in range(0, len(words), step):
        out += [x.ids for x in tokenizer.encode_batch_fast(words[i : i + step], add_special_tokens=False)]
    return out


def lexicon_file(docs: DataFrame, path: str, column: str, size: int) -> str:
    """Builds the automaton on the driver, adds it to the job's files and returns its name."""
    words = sorted(w.encode() for w in frequent(docs, column, False, size))
    arrays = build(words, encode_words(path, [w.decode() for w in words]))
    name = hashlib.sha256(b"".join(arrays[k].tobytes() for k in sorted(arrays))).hexdigest()[:24]
    # one place for one content: Spark takes a file of a name from one place only
    file = os.path.join(tempfile.gettempdir(), f"lexicon-{os.getuid()}-{name}.fst")
    save(arrays, file)
    docs.sparkSession.sparkContext.addFile(file)
    return os.path.basename(file)


def encode_rows(automaton: Transducer, path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids begin (one more entry at the end)."""
    own = units(texts, False)
    used = np.unique(own.codes)
    distinct = own.distinct.take(pa.array(used))
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(used) + 1] if len(used) else np.zeros(1, np.int64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8) if len(used) else np.zeros(0, np.uint8)
    at = automaton.find(data, offsets[:-1], offsets[1:])
    unseen = np.flatnonzero(at < 0)
    merged = encode_words(path, distinct.take(pa.array(unseen)).to_pylist())
    # one pool of ids: the automaton's, then those of the unseen words
    pool = np.concatenate([automaton.ids, np.fromiter((i for x in merged for i in x), np.uint32)])
    begin, length = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
    seen = at >= 0
    begin[seen] = automaton.begin[at[seen]]
    length[seen] = automaton.begin[at[seen] + 1].astype(np.int64) - begin[seen]
    length[unseen] = [len(x) for x in merged]
    begin[unseen] = len(automaton.ids) + np.cumsum(length[unseen]) - length[unseen]
    place = np.searchsorted(used, own.codes)
    n = length[place]
    total = np.append(0, np.cumsum(n))
    flat = np.repeat(begin[place] - total[:-1], n) + np.arange(total[-1])
    return pool[flat].astype("<u4"), total[own.first]


def decode_rows(path: str, ids: pa.Array, begins: np.ndarray) -> pa.Array:
    """The texts that the library's decode(ids, skip_special_tokens=False) gives, a row for each run of ids."""
    tokenizer = load(path)
    if tokenizer.decoder is not None:
        own = ids.to_pylist()
        runs = [own[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        return pa.array(tokenizer.decode_batch(runs, skip_special_tokens=False), pa.large_string())
    # a vocabulary without decoder is decoded by joining the tokens by a space
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    lists = pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(tokens, pa.large_string()).take(ids))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _mapped(docs: DataFrame, path: str, column: str, lexicon: int, fields: str, columns) -> DataFrame:
    name = lexicon_file(docs, path, column, lexicon)

    def rows(part: pa.RecordBatch) -> dict:
        return columns(*encode_rows(Transducer(SparkFiles.get(name)), path, part.column(column)))

    return append(docs, column, fields, rows)


def encode(docs: DataFrame, path: str, column: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """``docs`` with ids, array<int>."""

    def columns(ids: np.ndarray, begins: np.ndarray) -> dict:
        return {"ids": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))}

    return _mapped(docs, path, column, lexicon, "ids array<int>", columns)


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text of the ids."""
    from .words import map_rows

    def rows(part: pa.RecordBatch) -> dict:
        lists = part.column(column)
        begins = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        return {"decoded": decode_rows(path, lists.flatten(), begins)}

    return map_rows(encoded, "decoded string", rows)


def round_trip_digests(docs: DataFrame, path: str, column: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """``docs`` with n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""

    def columns(ids: np.ndarray, begins: np.ndarray) -> dict:
        raw = memoryview(ids.tobytes())
        bounds = list(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True))
        return {
            "n_tokens": np.diff(begins),
            "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in bounds],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decode_rows(path, pa.array(ids), begins).to_pylist()],
        }

    return _mapped(docs, path, column, lexicon, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
