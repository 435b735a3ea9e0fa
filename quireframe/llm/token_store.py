"""Token-ID output in patched frame-of-reference blocks.

Documents are encoded, followed by an end id, and laid out in ascending order of
id. A segment holds the documents of a run of that order:

    magic "QTS1"; three unsigned 32-bit numbers: block size, blocks, documents
    unsigned 64-bit: tokens
    per document: unsigned 32-bit number of tokens
    per block, the index: unsigned 64-bit byte offset of its data, unsigned 32-bit least id, unsigned 8-bit width,
        unsigned 32-bit number of exceptions
    per block, the data: ids less the block's least, ``width`` bits each, most significant first, padded to bytes;
        then exceptions: unsigned 16-bit places, unsigned 32-bit full differences

A block's width is chosen among percentiles of its bit lengths (PERCENTILES): the
one of least bytes, with the wider values as exceptions. Segments are rows of a
Parquet table in the cluster's shared folder, so that Spark's commit protocol
covers lost executors and any store that Spark reaches can hold them; a payload
written to a file of its own is complete. Numbers are little-endian.

A tokenizer whose file states that it lower-cases, splits at white space and ends
words with tokens of their own is given each word once: a batch's words are
gathered in a dictionary, and their ids remembered, up to a bound: half of it fills
up and then displaces the other half, so that words in use stay. Any other
tokenizer is given whole texts.

Defined results: null text is empty and has the end id alone. Null ids come first.
Rows of equal id follow each other in the order of their texts' hashes; rows equal in
both are written once each. Texts of any length are encoded whole. Other columns of
``docs`` are never read, whatever their names. No documents give no segment.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, shared_dir, slices

MAGIC = b"QTS1"
BLOCK = 1024
PERCENTILES = (50, 75, 90, 95, 99, 100)
#: A segment is closed once it has so many tokens.
SEGMENT = 1 << 18
CACHE = 400_000
END = 1
_HEAD = struct.Struct("<4sIIIQ")
_INDEX = np.dtype([("at", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "<u4")])


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned 32-bit value."""
    if x.size and x.max() >> 16:
        return np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    return _BITS[x]


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned 32-bit values to rows of bytes, ``width`` low bits each."""
    size = 2 if width <= 16 else 4
    if width == 8 * size:
        return x.astype(f">u{size}").view(np.uint8)
    bits = np.unpackbits(x.astype(f">u{size}").view(np.uint8).reshape(*x.shape, size), axis=-1)[..., 8 * size - width :]
    return np.packbits(bits.reshape(x.shape[0], -1), axis=1)


def _unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """Inverse of _pack: rows of bytes to rows of ``n`` values."""
    size = 2 if width <= 16 else 4
    if width == 8 * size:
        return np.ascontiguousarray(data).view(f">u{size}").astype(np.uint32)
    bits = np.unpackbits(data, axis=1)[:, : n * width].reshape(len(data), n, width)
    full = np.zeros((len(data), n, 8 * size), np.uint8)
    full[..., 8 * size - width :] = bits
    return np.packbits(full, axis=-1).view(f">u{size}").reshape(len(data), n).astype(np.uint32)


def write_segment(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of a segment of documents with so many tokens each."""
    n = len(ids)
    count = -(-n // block)
    index = np.zeros(count, _INDEX)
    padded = np.zeros(count * block, np.uint32)
    padded[:n] = ids
    if n % block:
        padded[n:] = ids[-1]
    rows = padded.reshape(count, block)
    index["least"] = rows.min(axis=1) if count else 0
    rows = rows - index["least"][:, None]
    bits = _bit_lengths(rows)
    sizes = np.minimum(block, n - np.arange(count) * block)
    # How many values of each block need at most so many bits; percentiles and exceptions follow from it.
    upto = np.bincount((np.arange(count)[:, None] * 33 + bits).ravel(), minlength=33 * count).reshape(count, 33).cumsum(axis=1)
    ranks = np.array([min(block, block * p // 100 + 1) for p in PERCENTILES])
    choices = (upto[:, :, None] < ranks).sum(axis=1)
    cost = choices * block + 48 * (block - np.take_along_axis(upto, choices, axis=1))
    width = choices[np.arange(count), cost.argmin(axis=1)] if count else np.zeros(0, np.int64)
    index["width"] = width
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        data = _pack(rows[which], int(w)) if w else np.zeros((len(which), 0), np.uint8)
        for i, row in zip(which.tolist(), data, strict=True):
            out = np.flatnonzero(bits[i] > w)
            out = out[out < sizes[i]]
            index["exceptions"][i] = len(out)
            packed[i] = row[: -(-int(sizes[i]) * int(w) // 8)].tobytes() + out.astype("<u2").tobytes() + rows[i, out].astype("<u4").tobytes()
    ends = np.cumsum([len(p) for p in packed]) if count else np.zeros(0, np.int64)
    start = _HEAD.size + 4 * len(lengths) + index.nbytes
    index["at"] = start + np.concatenate([[0], ends[:-1]]) if count else 0
    head = _HEAD.pack(MAGIC, block, count, len(lengths), n)
    return b"".join([head, lengths.astype("<u4").tobytes(), index.tobytes(), *packed])


def _read_head(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    magic, block, count, documents, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    lengths = np.frombuffer(data, "<u4", documents, _HEAD.size)
    index = np.frombuffer(data, _INDEX, count, _HEAD.size + 4 * documents)
    return block, n, lengths, index


def read_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks from ``first`` to before ``last``, found through the index."""
    block, n, _, index = _read_head(data)
    which = np.arange(len(index))[first:last]
    out = np.zeros((len(which), block), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.minimum(block, n - which * block)
    for w in np.unique(index["width"][which]):
        rows = np.flatnonzero(index["width"][which] == w)
        if w:
            room = -(-block * int(w) // 8)
            packed = np.zeros((len(rows), room), np.uint8)
            for k, r in enumerate(rows.tolist()):
                at, size = int(index["at"][which[r]]), -(-int(sizes[r]) * int(w) // 8)
                packed[k, :size] = raw[at : at + size]
            out[rows] = _unpack(packed, int(w), block)
    for r, i in enumerate(which.tolist()):
        if e := int(index["exceptions"][i]):
            at = int(index["at"][i]) + -(-int(sizes[r]) * int(index["width"][i]) // 8)
            out[r, np.frombuffer(data, "<u2", e, at)] = np.frombuffer(data, "<u4", e, at + 2 * e)
    out += index["least"][which][:, None]
    return out.ravel()[: int(sizes.sum())]


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of documents)."""
    return read_blocks(data), _read_head(data)[2]


#: The normaliser and the pre-tokenizer under which texts may be cut into words before they are encoded.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: Letters of Latin-1, whose lower case is one character of it, and other characters that are never part of an apostrophe's ending.
_LETTER, _BLANK, _MARK = "a-z\u00df-\u00f6\u00f8-\u00ff", "\t\n\x0b\x0c\r ", "!-&(-/:-@\\[-`{-~"
_UPPER = "A-Z\u00c0-\u00d6\u00d8-\u00de"
#: Texts of letters, digits, stops, commas and blanks, in which a stop or comma stands between a letter or digit and a blank or the end.
_PLAIN = rf"\A[{_BLANK}]*(?:[{_LETTER}{_UPPER}0-9]+[.,]?(?:[{_BLANK}]+|\z))*\z"
_KNOWN = rf"\A[{_LETTER}{_UPPER}0-9{_BLANK}{_MARK}]*\z"
#: The tokenizer's own words in lower-case text of known characters.
_WORDS = rf"[{_LETTER}]+|[0-9]|[{_MARK}]+"
_ONE_WORD = re.compile(_WORDS)


def splits_into_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, never joins across white space, and ends every word with an end-of-word token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("invert") is True
    added = {t["content"] for t in spec.get("added_tokens") or ()}
    return spec.get("normalizer") == _NORMALIZER and split and bool(spec["model"].get("end_of_word_suffix")) and added <= set(_SPECIALS)


class Encoder:
    """Ids of texts. Under a tokenizer that splits into words, words are remembered; under any other, whole texts are encoded."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.by_words = splits_into_words(path)
        #: Ids of words as bytes: those met since the last change of generations, and those of the generation before.
        self.seen: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_end[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for f in found for i in f], "<u4"), np.array([len(f) for f in found], np.int64)
        words = _words(texts)
        coded = words.flatten().dictionary_encode()
        ids = [self._of(coded.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, ids[0]), np.int64, len(ids[0])) // 4
        pool = np.frombuffer(b"".join(ids.pop()), "<u4")
        at, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        taken = sizes[which]
        upto = np.append(0, np.cumsum(taken))
        out = pool[np.repeat(at[which] - upto[:-1], taken) + np.arange(upto[-1])]
        edges = words.offsets.to_numpy()
        return out, np.diff(upto[edges - edges[0]])

    def _of(self, words: list[str]) -> list[bytes]:
        if 2 * len(self.seen) > CACHE:
            self.before, self.seen = self.seen, {"": b""}
        seen, before = self.seen, self.before
        ids = list(map(seen.get, words))
        new = []
        for i, known in enumerate(ids):
            if known is None:
                w = words[i]
                if (old := before.get(w)) is None:
                    new.append(i)
                else:
                    seen[w] = ids[i] = old
        simple = [i for i in new if words[i].isascii() and words[i].islower() and words[i].isalpha()]
        for k in range(0, len(simple), 2048):
            self._together([words[i] for i in simple[k : k + 2048]])
        rest = [words[i] for i in new if words[i] not in seen]
        known = [w for w in rest if _is_known(w)]
        for k in range(0, len(known), 2048):
            self._together(known[k : k + 2048])
        rest = [w for w in rest if w not in seen]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            seen[w] = array("I", e.ids).tobytes()
        for i in new:
            ids[i] = seen[words[i]]
        return ids

    def _together(self, words: list[str]) -> None:
        """Encode strings of known characters in one go: every word of the tokenizer in them ends with an end-of-word token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        counts = np.fromiter((1 if w.isalpha() else len(_ONE_WORD.findall(w)) for w in words), np.int64, len(words))
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) == counts.sum() and ends[-1] == 4 * len(ids):
            data, start = ids.tobytes(), 0
            for word, end in zip(words, ends[np.cumsum(counts) - 1].tolist(), strict=True):
                self.seen[word] = data[start:end]
                start = end


def _is_known(word: str) -> bool:
    """Lower-case and of known characters alone; special strings are left to the tokenizer."""
    return "<|" not in word and not _ONE_WORD.sub("", word)


def _words(texts: pa.Array) -> pa.ListArray:
    """The strings that each text is cut into; the tokenizer encodes them alike together or apart.

    Text of known characters falls, in lower case, into the tokenizer's own words, other text into what stands between
    ASCII white space, which the tokenizer treats as a separator whatever stands around it.
    """
    plain = pc.match_substring_regex(texts, _PLAIN).to_numpy(zero_copy_only=False)
    known = pc.match_substring_regex(texts, _KNOWN).to_numpy(zero_copy_only=False) & ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) & ~plain
    groups = [np.flatnonzero(plain), np.flatnonzero(known), np.flatnonzero(~plain & ~known)]
    a, b, c = (texts.take(pa.array(g)) for g in groups)
    a = pc.utf8_lower(a)
    for mark in ".,":
        a = pc.replace_substring(a, mark, " " + mark)
    b = pc.replace_substring_regex(pc.utf8_lower(b), rf"({_WORDS})", r"\1 ")
    lists = pa.concat_arrays([pc.ascii_split_whitespace(x) for x in (a, b, c)])
    return lists.take(pa.array(np.argsort(np.concatenate(groups), kind="stable")))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool) -> Encoder:
    """This process's encoder: Python workers serve many tasks, and what they have seen stays useful."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def write(docs: DataFrame, tokenizer: str, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, block: int = BLOCK, segment: int = SEGMENT, special_as_text: bool = False) -> str:
    """Write all documents; returns the folder. Segments of a partition are in order, and so are partitions."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    picked = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    # Rows of equal id are dealt by their texts' hashes, too.
    tie = F.xxhash64("text")
    ordered = picked.repartitionByRange(F.col("doc").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc").asc_nulls_first(), tie)
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = encoder(tokenizer, special_as_text), TaskContext.get().partitionId()
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        docs_of: list[pa.Array] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            flat, sizes, docs = np.concatenate(tokens), np.concatenate(lengths), pa.concat_arrays(docs_of)
            row = [pa.array([part]), pa.array([number]), pa.array([len(flat)]), pa.array([len(docs)]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([write_segment(flat, sizes, block)], pa.binary())]
            for held in (tokens, lengths, docs_of):
                held.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "number", "n_tokens", "n_docs", "docs", "payload"])

        for b in batches:
            for s in slices(b):
                ids, counts = encode(s.column(1))
                ends = np.cumsum(counts + 1)
                flat = np.full(int(ends[-1]), end, np.uint32)
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                at = 0
                while at < len(counts):
                    done = min(len(counts), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + segment - size)) + 1)
                    a, z = int(ends[at - 1]) if at else 0, int(ends[done - 1])
                    tokens.append(flat[a:z])
                    lengths.append(counts[at:done] + 1)
                    docs_of.append(s.column(0).slice(at, done - at))
                    size, at = size + z - a, done
                    if size >= segment:
                        yield close()
                        size, number = 0, number + 1
        if tokens:
            yield close()

    out = ordered.mapInArrow(run, f"part long, number long, n_tokens long, n_docs long, docs array<{kind}>, payload binary")
    out.write.parquet(path)
    return path


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per document, from the files: id, start (tokens before it), n_tokens, ids_crc32, and the ids if asked for."""
    stored = spark.read.parquet(path)
    kind = stored.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, number, docs, payload = (b.column(i)[k] for i in range(4))
                tokens, lengths = read_segment(payload.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                begins, data, n = ends - lengths, tokens.astype("<u4"), len(lengths)
                crc = [zlib.crc32(data[a:z].data) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [pa.array([part.as_py()] * n, pa.int64()), pa.array([number.as_py()] * n, pa.int64()), docs.values, pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["s_part", "s_number", "doc", "begin", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"s_part long, s_number long, doc {kind}, begin long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = stored.select("part", "number", "docs", "payload").mapInArrow(run, schema)
    # Tokens before a part, over a row per part, and before a segment within its part.
    total = stored.groupBy(F.col("part").alias("t_part")).agg(F.sum("n_tokens").alias("t"))
    ahead = F.coalesce(F.sum("t").over(W.orderBy("t_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored.select("part", "number", within.alias("within")).join(total.select("t_part", ahead.alias("ahead")), F.col("part") == F.col("t_part"))
    starts = starts.select("part", "number", (F.col("ahead") + F.col("within")).alias("before"))
    joined = rows.join(starts, (F.col("part") == F.col("s_part")) & (F.col("number") == F.col("s_number")))
    return joined.select(F.col("doc").alias(id_col), (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def index(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """read() without the ids themselves."""
    return read(spark, path, id_col=id_col, ids=False)
