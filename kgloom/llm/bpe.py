"""Byte-level BPE: encoding and decoding of whole texts over Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Texts are handed to the tokenizer, and batches handed back, in runs of about so many bytes.
RUN_CHARS = 2_000_000


def byte_table() -> dict[int, str]:
    """The character that stands for each byte: itself where it is visible Latin-1, else from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary, split by a fixed pattern before its merges apply.

    path is a tokenizers JSON file. Special tokens are never recognised in a text and never added.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        back = {c: b for b, c in byte_table().items()}
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            known = all(c in back for c in token)
            self.token_bytes[k] = bytes(back[c] for c in token) if known else token.encode()
        self.token_len = np.array([len(x) for x in self.token_bytes], dtype=np.int64)

    @classmethod
    def of(cls, path: str) -> Codec:
        """One codec for each Python worker and file."""
        held = sys.modules.setdefault("_kgloom_held", types.ModuleType("_kgloom_held")).__dict__
        if ("codec", path) not in held:
            held["codec", path] = cls(path)
        return held["codec", path]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, in order; None is encoded as the empty text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; characters that tokens split come together again as bytes."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of each token in text.

        A token that holds only a part of a character covers that whole character, so neighbours
        that share one overlap by it.
        """
        ends = np.cumsum(self.token_len[ids]) if ids else np.zeros(0, np.int64)
        starts = ends - self.token_len[ids] if ids else ends
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # by byte
        if not ids:
            return ends, ends
        return char_of[starts], char_of[ends - 1] + 1


def _text_runs(batches, text: int | str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of about RUN_CHARS bytes of text, at least a row each, with their texts."""
    for batch in batches:
        column, start, chars = batch.column(text), 0, 0
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for k, size in enumerate(sizes):
            chars += size
            if chars >= RUN_CHARS or k + 1 == len(sizes):
                part = batch.slice(start, k + 1 - start)
                yield part, part.column(text).to_pylist()
                start, chars = k + 1, 0


def _lists(found: list[list[int]]) -> pa.Array:
    """Lists of ids as an Arrow column."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _replace(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [k for k in range(batch.num_columns) if batch.schema.names[k] not in added]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k) for k in keep), *added.values()], [*(batch.schema.names[k] for k in keep), *added]
    )


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *added])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """df with a column of token ids, and with offsets also {ids}_start and {ids}_end.

    Null and empty texts get an empty list. Texts of any length are encoded whole. Columns of df
    with the added names are replaced; all others, rows and repeated rows stay as they are. An
    empty table gives an empty table. No exchange.
    """
    longs = T.ArrayType(T.IntegerType(), False)
    names = [ids, f"{ids}_start", f"{ids}_end"][: 3 if offsets else 1]

    def run(batches):
        codec = Codec.of(path)
        for batch, texts in _text_runs(batches, text):
            found = codec.encode(texts)
            added = {ids: _lists(found)}
            if offsets:
                spans = [codec.offsets(x or "", k) for x, k in zip(texts, found)]
                for n, name in enumerate(names[1:]):
                    added[name] = _lists([s[n] for s in spans])
            yield _replace(batch, added)

    return df.mapInArrow(run, _schema(df, [T.StructField(n, longs) for n in names]))


def encode_proven(df: DataFrame, path: str, text: str = "text", ids: str = "ids", proof: str = "round_trip") -> DataFrame:
    """encode() with a column that says whether decode() of the ids gives the text's bytes again.

    One pass, in which no more than a run of texts is decoded at a time. Nulls, empty and long texts,
    repeated rows, empty tables and clashing names as in encode(); a null text is proven if its
    list is empty.
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(proof, T.BooleanType())]

    def run(batches):
        codec = Codec.of(path)
        for batch, texts in _text_runs(batches, text):
            found = codec.encode(texts)
            same = [codec.decode(k) == (x or "").encode() for x, k in zip(texts, found)]
            yield _replace(batch, {ids: _lists(found), proof: pa.array(same, pa.bool_())})

    return df.mapInArrow(run, _schema(df, added))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of its id lists, and {out}_text: them as text, with U+FFFD where they are not UTF-8.

    Null and empty lists give empty bytes; ids outside the vocabulary fail. Columns of df with the
    added names are replaced; all others, rows and repeated rows stay. Lists of any length are
    decoded whole. An empty table gives an empty table.
    """
    added = [T.StructField(out, T.BinaryType()), T.StructField(f"{out}_text", T.StringType())]

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            text = [x.decode("utf-8", "replace") for x in raw]
            yield _replace(batch, {out: pa.array(raw, pa.binary()), f"{out}_text": pa.array(text, pa.string())})

    return df.mapInArrow(run, _schema(df, added))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() of each text in one pass, of which only counts and digests stay.

    Returns key, n_tokens, ids_sha256 (of decimal ids joined by one space) and decoded_sha256. A null
    text counts as empty, a null key stays null, repeated rows stay; texts of any length are
    encoded whole, other columns are ignored, an empty table gives no rows.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        from hashlib import sha256

        codec = Codec.of(path)
        shown = [str(k) for k in range(len(codec.token_bytes))]
        for batch, texts in _text_runs(batches, 1):
            n, a, b = [], [], []
            for ids in codec.encode(texts):
                n.append(len(ids))
                a.append(sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=schema.names,
            )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
