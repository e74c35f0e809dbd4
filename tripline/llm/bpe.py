"""Byte-level BPE with exact results for whole texts of any length.

The vocabulary file is one of the ``tokenizers`` library and ids equal those of its
``encode(text, add_special_tokens=False)``.  Three facts allow work in pieces:

* Before a white-space character that follows another kind of character there is
  always a border between pre-tokens, whatever stands around it.  So text may be cut
  there, and equal words may share one result (two bounded caches per task).
* Pre-tokens are encoded independently.
* Inside a pre-token, a sequence of tokens is the encoding exactly if every two
  neighbours are the encoding of their own bytes.  So halves may be encoded apart; the
  tokens around the join are encoded anew in growing windows until the outermost token
  of the window agrees with the half on either side.

Long texts are cut into pieces that are encoded in parallel tasks, then joined as a
tree.  Null text is empty text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.arrow import int_lists, release, slices, small_batches, with_columns
from tripline.session import materialize

#: A text of so many characters takes a task a fraction of a second; only longer ones are cut and shuffled.
PIECE_CHARS = 262_144
RUN_BYTES = 1_024
#: Parts that a task keeps encoded (about 250 bytes each); half as many more are shared out below.
CACHED = 800_000
TEXT, START, MORE = 0, 1, 2

# The pre-token pattern of byte-level BPE files of this kind.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACES = " \t\n\v\f\r"
#: Everything that one of the regular-expression libraries may take for white space.
_MAYBE_SPACE = r"\s\x1c-\x1f\x85᠎​﻿"
_STARTS_WITH_SPACE = re.compile(rf"[{_MAYBE_SPACE}]").match
_ODD_SPACE = rf"(?:(?![{_SPACES}])[{_MAYBE_SPACE}])"
_CHUNK = re.compile(
    rf"[{_MAYBE_SPACE}]*[^{_MAYBE_SPACE}]+(?:{_ODD_SPACE}[{_MAYBE_SPACE}]*[^{_MAYBE_SPACE}]+)*|[{_MAYBE_SPACE}]+"
)
#: Characters on whose classes all Unicode versions agree.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\u024f]*")


#: Up to here, ``str.isalpha`` and the pattern's letters are the same.
_LETTERS_END = "\u0250"
_ASCII_PRETOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
).findall
_ASCII_PLAIN = re.compile(r"[\t-\r\x20-\x7e]*").fullmatch
#: One of these that ends a part is a pre-token if letters are before it.
_MARKS = frozenset(",.;:!?")


def _letters(text: str) -> bool:
    """Whether the pattern takes all of ``text`` for letters; false if that isn't sure."""
    return text.isalpha() and (text.isascii() or max(text) < _LETTERS_END)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    code = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
    return [chr(code[b]) for b in range(256)]


def token_bytes(spec: dict) -> dict[int, bytes]:
    """What each id of a vocabulary file stands for."""
    back = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
    made = {}
    for token, number in spec["model"]["vocab"].items():
        plain = all(c in back for c in token)
        made[number] = bytes(back[c] for c in token) if plain else token.encode()
    return made | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def decoded(table: dict[int, bytes], ids: np.ndarray) -> str:
    """The text of ids, special tokens included; unknown ids give nothing."""
    return b"".join([table.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


class _SpaceRun(Exception):
    """A space is followed by white space, so the text can't be split at every space."""


class _Cache(dict):
    """A dict that computes what it lacks and keeps about ``limit`` results, the ones used last.

    When half of them are new, those become the old generation and the old one goes; an old
    result that is asked for again is new again.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.half, self.old = make, max(limit // 2, 1), {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) < 64:
            if len(self) >= self.half:
                self.old = self.copy()
                self.clear()
            self[key] = made
        return made


class Encoder:
    """Encodes and decodes in one process; ids are little-endian 32-bit byte strings."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Files of another build are encoded by the library alone.
        self.known = (
            spec["normalizer"] is None
            and spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.symbols = dict(enumerate(byte_symbols()))
        self.token_bytes = token_bytes(spec)
        self.split = regex.compile(PRETOKENS).findall
        self.words = _Cache(self._word, cached // 4)
        self.parts = _Cache(self._part, cached + cached // 4)
        self.heads = _Cache(self._chunk, cached // 8)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self._by_library(text)
        parts = text.split(" ")
        try:
            head = self.heads[parts[0]] if parts[0] else b""
            return head + b"".join(map(self.parts.__getitem__, parts[1:]))
        except _SpaceRun:
            return b"".join(map(self.heads.__getitem__, _CHUNK.findall(text)))

    def decode(self, ids: np.ndarray) -> str:
        return decoded(self.token_bytes, ids)

    def cut(self, text: str, size: int) -> list[tuple[str, int]]:
        """Pieces of at most about ``size`` characters, each with its kind.

        TEXT: whole pre-tokens; START: the first part of one pre-token, or all of it; MORE: a later part.
        """
        if not self.known:
            return [(text, TEXT)]
        pieces: list[tuple[str, int]] = []
        held: list[str] = []

        def flush():
            # White space that ends a piece would be read otherwise without what follows it.
            end = len(held)
            while end and held[end - 1].isspace():
                end -= 1
            if end:
                pieces.append(("".join(held[:end]), TEXT))
            pieces.extend((space, START) for space in held[end:])
            held.clear()

        length = 0
        for chunk in _CHUNK.findall(text):
            if length + len(chunk) > size:
                flush()
                length = 0
            if len(chunk) <= size or any(s in chunk for s in self.special):
                held.append(chunk)
                length += len(chunk)
                continue
            for word in self._pretokens(chunk):
                if length + len(word) > size:
                    flush()
                    length = 0
                if len(word) <= size:
                    held.append(word)
                    length += len(word)
                else:
                    pieces += [(word[i : i + size], MORE if i else START) for i in range(0, len(word), size)]
            flush()
            length = 0
        if held:
            pieces.append(("".join(held), TEXT))
        return pieces

    def join(self, left: bytes, right: bytes) -> bytes:
        """The encoding of one pre-token's two halves, from the encodings of the halves."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        width = 4
        while len(a) and len(b):
            k, m = min(width, len(a)), min(width, len(b))
            around = self._merge(b"".join(self.token_bytes[int(i)] for i in (*a[-k:], *b[:m])))
            new = np.frombuffer(around, "<u4")
            if (k == len(a) or new[0] == a[-k]) and (m == len(b) or new[-1] == b[m - 1]):
                return a[: len(a) - k].tobytes() + around + b[m:].tobytes()
            width *= 2
        return left + right

    def join_all(self, encoded: list[bytes], kinds: list[int]) -> bytes:
        """The ids of a text from those of its pieces; the parts of each split pre-token are joined as a tree."""
        runs: list[list[bytes]] = []
        for part, kind in zip(encoded, kinds, strict=True):
            if kind == MORE:
                runs[-1].append(part)
            else:
                runs.append([part])
        return b"".join(map(self._tree, runs))

    def _tree(self, parts: list[bytes]) -> bytes:
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]

    def piece(self, text: str, kind: int) -> bytes:
        """One piece of ``cut``; a part of a pre-token is merged without looking for pre-tokens in it."""
        return self.encode(text) if kind == TEXT else self._word(text)

    def _by_library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretokens(self, chunk: str) -> list[str]:
        if _ASCII_PLAIN(chunk):
            return _ASCII_PRETOKENS(chunk)
        if _PLAIN.fullmatch(chunk):
            return self.split(chunk)
        found = self.library.pre_tokenizer.pre_tokenize_str(chunk)
        return [chunk[a:b] for _, (a, b) in found]

    def _part(self, part: str) -> bytes:
        """A part that follows one space."""
        if part.isascii() and part.isalpha() and len(part) < 63:
            return self._ids(self.symbols[32] + part)
        if part.isalpha() and max(part) < _LETTERS_END:
            return self._word(" " + part)
        if not part or _STARTS_WITH_SPACE(part):
            raise _SpaceRun
        stem, mark = part[:-1], part[-1]
        if mark in _MARKS and _letters(stem):
            return self.parts[stem] + self.words[mark]
        if "\n" in part and "<" not in part:
            before, _, line = part.partition("\n")
            # A line feed between two such characters is a pre-token, so what is around it stands alone.
            if "!" <= before[-1:] <= "~" and ("!" <= line[:1] <= "~" or _letters(line[:1])):
                return self.parts[before] + self.words["\n"] + self.heads[line]
        return self._chunk(" " + part)

    def _chunk(self, chunk: str) -> bytes:
        if "<" in chunk and any(s in chunk for s in self.special):
            return self._by_library(chunk)
        if _letters(chunk):
            return self._word(chunk)
        if chunk[-1:] in _MARKS and _letters(chunk[:-1]):
            return self.words[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.words.__getitem__, self._pretokens(chunk)))

    def _word(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha() and len(word) < 64:
            return self._ids(word.replace(" ", self.symbols[32]))
        return self._run(word.encode())

    def _run(self, run: bytes) -> bytes:
        if len(run) <= RUN_BYTES:
            return self._merge(run)
        half = len(run) // 2
        return self.join(self._run(run[:half]), self._run(run[half:]))

    def _merge(self, run: bytes) -> bytes:
        """BPE of a few bytes; they need not be whole characters."""
        return self._ids(run.decode("latin-1").translate(self.symbols))

    def _ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One encoder per Python worker; another file or size takes its place."""
    return Encoder(path, cached)


@lru_cache(maxsize=2)
def byte_table(path: str) -> dict[int, bytes]:
    """``token_bytes`` of a file, once a worker; decoding needs no more than this."""
    with open(path, encoding="utf-8") as file:
        return token_bytes(json.load(file))


def encode(
    df: DataFrame,
    path: str,
    text: str = "text",
    ids: str = "ids",
    piece_chars: int = PIECE_CHARS,
    *,
    keep_text: bool = True,
    decoded_text: str | None = None,
    cached: int = CACHED,
) -> DataFrame:
    """``df`` with ``ids`` array<int> of each whole text.

    Texts up to ``piece_chars`` are encoded where they are read.  Longer ones are cut,
    their pieces dealt over all tasks, encoded, and joined again by row.  Null and empty
    texts give an empty array; repeated rows stay; an empty table gives an empty table.
    A column already called ``ids`` is replaced.  ``decoded_text`` names a column for the text
    that the ids stand for, made in the same tasks; without ``keep_text`` the text itself is
    left out (and ``decoded_text`` may take its name).  A task keeps ``cached`` parts.
    """
    made = [T.StructField(ids, T.ArrayType(T.IntegerType()), False)]
    if decoded_text is not None:
        made.append(T.StructField(decoded_text, T.StringType(), False))
    df = small_batches(df).drop(*[f.name for f in made if f.name != text])
    rest = [c for c in df.columns if keep_text and c not in [f.name for f in made] or c != text]
    size = F.coalesce(F.length(text), F.lit(0))
    schema = T.StructType([*df.select(*map(_quoted, rest)).schema.fields, *made])

    def outputs(coder: Encoder, encoded: list[bytes]) -> dict[str, pa.Array]:
        columns = {ids: int_lists(encoded)}
        if decoded_text is not None:
            columns[decoded_text] = pa.array([coder.decode(np.frombuffer(e, "<u4")) for e in encoded], pa.string())
        return columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, cached)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                columns = outputs(coder, [coder.encode(x) if x else b"" for x in texts])
                yield with_columns(part.select(rest), **columns)
        release()

    def joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, cached)
        for batch in batches:
            for k, pieces in enumerate(batch["pieces"]):
                parts = pieces.as_py()
                columns = outputs(coder, [coder.join_all([p["piece_ids"] for p in parts], [p["kind"] for p in parts])])
                yield with_columns(batch.select(["row"]).slice(k, 1), **columns)
        release()

    short = df.where(size <= piece_chars).mapInArrow(whole, schema)
    # Row numbers must not change if a task is run again, so the long rows are written first.
    long = materialize(
        df.where(size > piece_chars).select(
            F.struct(F.lit(1).alias("_"), *map(_quoted, rest)).alias("row"),
            _quoted(text).alias("long_text"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "long-texts",
    )
    # The other columns go with a text's first piece, so its ids need not be shuffled again to meet them.
    row = T.StructField("row", long.schema["row"].dataType)
    piece = [T.StructField("row_no", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("kind", T.IntegerType())]
    pieces = long.select("row", "row_no", "long_text").mapInArrow(
        _cutter(path, piece_chars, cached), T.StructType([*piece, T.StructField("piece", T.StringType()), row])
    )
    encoded = pieces.repartition("row_no", "seq").mapInArrow(
        _piece_encoder(path, cached), T.StructType([*piece, T.StructField("piece_ids", T.BinaryType()), row])
    )
    joined = encoded.groupBy("row_no").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "piece_ids"))).alias("pieces"),
        F.first("row", ignorenulls=True).alias("row"),
    )
    joined = joined.select("row", "pieces").mapInArrow(joined_rows, T.StructType([row, *made]))
    back = [F.col("row").getField(c).alias(c) for c in rest]
    return short.unionByName(joined.select(*back, *[_quoted(f.name) for f in made]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``, special tokens included; null ids give an empty text."""
    df = small_batches(df).drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(ids).fill_null([]) if part.column(ids).null_count else part.column(ids)
                values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = [decoded(table, values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield with_columns(part, **{text: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def _quoted(name: str):
    return F.col(f"`{name}`")


def _cutter(path: str, size: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, cached)
        for batch in batches:
            for k, (number, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("row_no", "long_text")), strict=True)):
                pieces = coder.cut(text, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(pieces), pa.int64()),
                        pa.array(range(len(pieces)), pa.int32()),
                        pa.array([p[1] for p in pieces], pa.int32()),
                        pa.array([p[0] for p in pieces], pa.string()),
                        batch["row"].take(pa.array([k] + [None] * (len(pieces) - 1), pa.int64())),
                    ],
                    ["row_no", "seq", "kind", "piece", "row"],
                )

    return run


def _piece_encoder(path: str, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, cached)
        for batch in batches:
            made = [coder.piece(p, i) for p, i in zip(batch["piece"].to_pylist(), batch["kind"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["row_no"], batch["seq"], batch["kind"], pa.array(made, pa.binary()), batch["row"]],
                ["row_no", "seq", "kind", "piece_ids", "row"],
            )
        release()

    return run
