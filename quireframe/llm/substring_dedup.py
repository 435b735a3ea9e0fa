"""Substring dedup by sliding sentence spans.

Words stand between ASCII white space, A-Z lower-cased; every character of a script
that is written without blanks (``DENSE``) is a word of its own. A sentence ends
after a word that ends in a full stop, question or exclamation mark (closing quotes
and brackets may follow), of East Asian scripts too, and at a line end. One of more
than ``LONGEST`` words is cut where the hash of two neighbouring words is the least
of ``WINDOW`` places in a row, so that equal words are cut alike wherever they
stand, and no piece has more than ``WINDOW`` words. A passage of 50 words loses at
most 15 at either end to its surroundings, by an uncut sentence or by places that
see beyond the passage, and what is left has at least two pieces and 20 words.

From every sentence a span runs over the following ones until it has
``min_sentences`` sentences and ``min_words`` words, and to every sentence one runs
back over those before it in the same way: together they cover what all longer runs
that repeat cover. A span that runs back begins with the span that runs forward from
its first sentence, so it travels with that one, as eight more bytes. Spans are
joined over the whole corpus by 96 bits of hash (160 for those that run back); all
but the first occurrence, by id, text hash and place, are repeats, and the sentences
that a repeat covers are removed. What stays is the text as it was, piece by piece.

Two passes: the first counts one hash a span, combined before the shuffle; the
second sends the spans through a semi-join with the hashes that occur twice or more,
and what is left is ordered within its hash, where it is. Hashes of more than one in
``HOT`` of all repeated spans, fewer than HOT of them, are known from the first pass:
their spans are dealt out by document, ordered part by part, and only the first of
each part are brought together.

``first_docs`` names the first document of each repeated span; of a hot one, that
of the part, which comes before it, too.

Defined results: null stays null, empty stays empty; a text without words has no
sentence. A null id comes first in the order. Rows equal in id and text are one
document: none is a repeat of another. A text shorter than a span has none and stays
whole. A span that repeats within its own text is removed there, too, from the second
place on. Texts of any length are worked whole. Other columns of ``docs`` are never
read, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stored

MIN_SENTENCES = 2
MIN_WORDS = 20
LONGEST = 15
WINDOW = 8
#: Scripts without blanks between words, as ranges of code points: Thai to Lao, Burmese, Khmer, kana to ideographs, full-width forms, later planes of ideographs.
DENSE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFFEF), (0x20000, 0x3FFFF))
#: Full stops, question and exclamation marks of East Asian scripts.
DENSE_STOPS = (0x3002, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61)
#: A hash is hot if over one in HOT of all repeated spans have it; its spans go to PARTS parts.
HOT = 2_000
PARTS = 64
_ROWS = 256
_PLACE = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd bases of the sums that give a run of sentences its hash, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC6BC279692B5C323)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Layout:
    """Sentences of several texts: ``first`` word of each (and the end), its text, and the texts' first sentences.

    ``data`` and ``off`` are the texts' bytes and where each begins; ``start`` and ``end`` are the words' places in them.
    """

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text: np.ndarray
    begins: np.ndarray


def _dense(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, is a stop) of the characters of scripts without blanks."""
    lead = np.flatnonzero(data >= 0xE0)
    size = np.where(data[lead] >= 0xF0, 4, 3)
    at = lambda i: data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 0x3F
    three = ((data[lead].astype(np.int64) & 0x0F) << 12) | (at(1) << 6) | at(2)
    code = np.where(size == 3, three, ((data[lead].astype(np.int64) & 0x07) << 18) | (at(1) << 12) | (at(2) << 6) | at(3))
    is_dense = np.zeros(len(code), bool)
    for a, b in DENSE:
        is_dense |= (code >= a) & (code <= b)
    return lead[is_dense], size[is_dense], np.isin(code[is_dense], DENSE_STOPS)


def layout(texts: pa.Array) -> Layout:
    """Words and sentences of an array of strings without nulls."""
    raw = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    none = np.zeros(0, np.int64)
    if not len(data):
        return Layout(data, off, none, none, np.zeros(1, np.int64), none, np.zeros(len(texts) + 1, np.int64))
    full = off[:-1][np.diff(off) > 0]
    space = _SPACE[data]
    begin = np.ones(len(data), bool)
    begin[1:] = space[:-1]
    begin[full] = True
    begin &= ~space
    stops = np.zeros(0, np.int64)
    if data.max() >= 0xE0:
        place, size, is_stop = _dense(data, off)
        begin[place] = True
        after = place + size
        after = after[after < len(data)]
        begin[after[~space[after]]] = True
        stops = (place + size)[is_stop]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:] | begin[1:]
    last[off[1:][np.diff(off) > 0] - 1] = True
    last &= ~space
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if not len(start):
        return Layout(data, off, none, none, np.zeros(1, np.int64), none, np.zeros(len(texts) + 1, np.int64))
    owner = np.searchsorted(off, start, "right") - 1
    # A sentence begins at a text's first word, after a stop, and after a line end.
    ends = data[end - 1]
    stopped = _STOP[ends] | (_CLOSE[ends] & (end - start > 1) & _STOP[data[np.maximum(end - 2, 0)]])
    if len(stops):
        stopped |= np.isin(end, stops)
    lines = np.searchsorted(np.flatnonzero(data == 10), start)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | stopped[:-1] | (lines[1:] != lines[:-1])
    sentence = np.cumsum(new) - 1
    _cut(new, sentence, data, start, end)
    first = np.flatnonzero(new)
    text = owner[first]
    begins = np.searchsorted(text, np.arange(len(texts) + 1))
    return Layout(data, off, start, end, np.append(first, len(start)), text, begins)


def _cut(new: np.ndarray, sentence: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Mark where pieces of sentences of more than LONGEST words begin."""
    is_long = np.bincount(sentence) > LONGEST
    window = np.flatnonzero(is_long[sentence[:-WINDOW]] & (sentence[:-WINDOW] == sentence[WINDOW:])) if len(start) > WINDOW else np.zeros(0, np.int64)
    if not len(window):
        return
    # A word's mark: its length, first and last four bytes, which is enough to choose places by.
    h = (end - start).astype(np.uint64)
    for i in range(4):
        for at in (np.minimum(start + i, end - 1), np.maximum(end - 1 - i, start)):
            h = h * _M1 + _LOWER[data[at]]
    pair = _mix(h[:-1] * _M1 + h[1:])
    # The place of the least of WINDOW pairs from each place on, the last of equal ones.
    least, span = np.arange(len(pair)), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(pair[b] <= pair[a], b, a)
        span += step
    new[least[window] + 1] = True


def digests(at: Layout) -> np.ndarray:
    """Two unsigned 64-bit numbers a sentence: the hash of its words with single blanks between them."""
    size = at.end - at.start
    ends = np.cumsum(size + 1)
    inside = np.repeat(at.start - (ends - size - 1), size) + np.delete(np.arange(int(ends[-1])), ends - 1) if len(size) else np.zeros(0, np.int64)
    joined = np.full(int(ends[-1]) if len(size) else 0, 32, np.uint8)
    filled = np.ones(len(joined), bool)
    filled[ends - 1] = False
    joined[filled] = _LOWER[at.data[inside]]
    edges = np.append(0, ends)[at.first]
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    out = b"".join([digest(view[a : b - 1]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
    return np.frombuffer(out, ">u8").reshape(-1, 2).astype(np.uint64)


def runs(at: Layout, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the shortest span from each sentence, and (start, end) of those to a sentence that differ from all of these."""
    words, begin, stop = at.first, at.begins[at.text], at.begins[at.text + 1]
    n = np.arange(len(at.text))
    end = np.maximum(n + min_sentences, np.searchsorted(words, words[:-1] + min_words))
    ok = end <= stop
    to = n + 1
    back = np.minimum(to - min_sentences, np.searchsorted(words, words[to] - min_words, "right") - 1)
    longer = back >= begin
    back, to = back[longer], to[longer]
    longer = to > end[back]
    return n[ok], end[ok], back[longer], to[longer]


def _hash(digest: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Of each run of sentences: the sum of digest times base to the power of its place in the run."""
    n = len(digest)
    power, undo = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    power[:1] = undo[:1] = 1
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(digest * np.cumprod(power), out=upto[1:])
    return _mix((upto[end] - upto[start]) * np.cumprod(undo)[start])


def spans(texts: pa.Array, min_sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, first sentence, number of sentences, h1, h2, offsets, longer) of the spans from sentences.

    ``longer`` holds the hashes of the spans to sentences that begin with the same sentence, in order of their
    ends, of which the first is one sentence longer than the span itself; ``offsets`` tells which are whose.
    """
    at = layout(texts)
    digest = digests(at)
    start, end, back, to = runs(at, min_sentences, min_words)
    h = [_hash(digest[:, i], start, end, _BASES[i], _INVERSES[i]) for i in (0, 1)]
    longer = _hash(digest[:, 0], back, to, _BASES[2], _INVERSES[2])
    offsets = np.searchsorted(back, np.append(start, len(at.text)))
    return at.text[start], start - at.begins[at.text[start]], end - start, h[0].view(np.int64), (h[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), offsets, longer


def _has_keys(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    ids = docs.groupBy(col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return ids.where("n > 1 or id is null").isEmpty()


def _keyed(docs: DataFrame, id_col: str, text_col: str, by_id: bool) -> DataFrame:
    """(doc, tkey, text): tkey tells rows of one id apart, by their text; it is 0 if no two rows share an id."""
    text = col(text_col)
    return docs.select(col(id_col).alias("doc"), (F.lit(0).cast("long") if by_id else F.xxhash64(text)).alias("tkey"), text.alias("text"))


def span_rows(docs: DataFrame, *, id_col: str, text_col: str, min_sentences: int, min_words: int, by_id: bool = False, hashes_only: bool = False) -> DataFrame:
    """(h1) or (doc, tkey, place, h1, h2, longer): place is the first sentence and, in 16 bits, the number of sentences."""
    if not 0 < min_words < 1 << (_PLACE - 1) or not 0 < min_sentences < 1 << (_PLACE - 1):
        raise ValueError("min_words and min_sentences must be from 1 to 32767")
    picked = _keyed(docs, id_col, text_col, by_id)
    picked = picked.select("text") if hashes_only else picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                s = b.slice(k, _ROWS)
                text, start, n, h1, h2, offsets, longer = spans(pc.fill_null(s.column("text"), ""), min_sentences, min_words)
                if hashes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(h1)], names=["h1"])
                    continue
                more = pa.BinaryArray.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(longer)])
                arrays = [s.column(0).take(pa.array(text)), s.column(1).take(pa.array(text)), pa.array(start << _PLACE | n), pa.array(h1), pa.array(h2), more]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "tkey", "place", "h1", "h2", "longer"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return picked.mapInArrow(run, "h1 long" if hashes_only else f"doc {kind}, tkey long, place long, h1 long, h2 int, longer binary")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, by_id: bool = False, hot: int = HOT, parts: int = PARTS) -> DataFrame:
    """(doc, tkey, place, first_doc): every occurrence of a span but the first of its hash."""
    options = {"id_col": id_col, "text_col": text_col, "min_sentences": min_sentences, "min_words": min_words}
    counted = span_rows(docs, **options, hashes_only=True).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")
    twice = stored(counted, "repeated-hashes")  # equal rows count twice, but have one place
    total = twice.agg(F.sum("n")).first()[0] or 0
    # Fewer than ``hot`` rows, as each has over one in ``hot`` of all.
    often = F.broadcast(twice.where(F.col("n") * hot > total).select(F.col("h1").alias("o1")))
    is_hot, on = F.col("o1").isNotNull(), F.col("h1") == F.col("o1")
    part = F.when(is_hot, F.pmod(F.xxhash64("doc", "tkey"), F.lit(parts)).cast("int")).otherwise(-1)
    every_part = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(-1))))
    wanted = twice.join(often, on, "left").select("h1", every_part.alias("part"))
    rows = span_rows(docs, **options, by_id=by_id).join(often, on, "left").withColumn("part", part).drop("o1")
    rows = rows.join(wanted, ["h1", "part"], "left_semi")
    piece = lambda i: F.substring("longer", 8 * i + 1, F.lit(8))
    count = (F.octet_length("longer") / 8).cast("int")
    beyond = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i + 1).alias("more"), piece(i).alias("x")))
    own = F.array(F.struct(F.lit(0).alias("more"), F.lit(b"").alias("x")))
    each = F.when(count > 0, F.concat(own, beyond)).otherwise(own)
    every = rows.select("doc", "tkey", "place", "h1", "h2", "part", F.inline(each)).withColumn("place", F.col("place") + F.col("more"))
    spot = F.struct("doc", "tkey", "place")

    def led(df: DataFrame, *keys: str) -> DataFrame:
        """With the first place of each key."""
        ahead = W.partitionBy(*keys).orderBy("doc", "tkey", "place").rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("first", F.first(spot).over(ahead))

    # The semi-join has dealt the rows by hash and part, so that this window needs no exchange.
    kept = led(every, "h1", "part", "h2", "x").where((spot != F.col("first")) | (F.col("part") >= 0))
    key = F.when(spot == F.col("first"), F.struct("h1", "h2", "x"))
    kept = stored(kept.select("doc", "tkey", "place", F.col("first.doc").alias("first_doc"), key.alias("key")), "repeated-spans")
    # Firsts of a hot hash's parts: at most ``parts`` of one key.
    firsts = led(kept.where("key is not null").select("doc", "tkey", "place", "key.*"), "h1", "h2", "x").where(spot != F.col("first"))
    firsts = firsts.select("doc", "tkey", "place", F.col("first.doc").alias("first_doc"))
    return kept.where("key is null").drop("key").union(firsts)


def _without(texts: pa.Array, places: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the sentences that ``places`` cover, sentences removed, words removed)."""
    at = layout(texts)
    owner = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    place = places.values.to_numpy()[places.offsets[0].as_py() : places.offsets[-1].as_py()] if len(places.values) else np.zeros(0, np.int64)
    start = at.begins[owner] + (place >> _PLACE)
    marks = np.bincount(start, minlength=len(at.text) + 1) - np.bincount(start + (place & ((1 << _PLACE) - 1)), minlength=len(at.text) + 1)
    gone = np.cumsum(marks)[:-1] > 0
    # A sentence's bytes run to the next one's; the first one's begin with the text.
    edge = at.start[at.first[:-1]]
    head = np.append(True, at.text[1:] != at.text[:-1]) if len(at.text) else np.zeros(0, bool)
    edge = np.where(head, at.off[at.text], edge)
    until = np.append(edge[1:], 0)
    tail = np.append(at.text[1:] != at.text[:-1], True) if len(at.text) else np.zeros(0, bool)
    until = np.where(tail, at.off[at.text + 1], until)
    flips = np.zeros(len(at.data) + 1, np.int8)
    np.add.at(flips, edge[gone], 1)
    np.add.at(flips, until[gone], -1)
    stay = np.cumsum(flips[:-1], dtype=np.int8) == 0
    lost = np.bincount(at.text[gone], (until - edge)[gone], len(texts)).astype(np.int64)
    off = at.off - np.append(0, np.cumsum(lost))
    kept = pa.StringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(at.data[stay])))
    words = np.diff(at.first)
    return kept, np.bincount(at.text[gone], minlength=len(texts)), np.bincount(at.text[gone], words[gone], len(texts)).astype(np.int64)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, text (what stays), n_removed (sentences), removed_words, first_docs (sorted ids)."""
    by_id = _has_keys(docs, id_col)
    found = repeats(docs, id_col=id_col, text_col=text_col, by_id=by_id, **options)
    by_doc = found.groupBy(F.col("doc").alias("r_doc"), F.col("tkey").alias("r_key")).agg(
        F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set("first_doc")).alias("first_docs")
    )
    keyed = _keyed(docs, id_col, text_col, by_id)
    kind = keyed.schema[0].dataType.simpleString()
    joined = keyed.join(by_doc, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("tkey") == F.col("r_key")), "left")
    none = F.array().cast("array<long>")
    picked = joined.select("doc", "text", F.coalesce("places", none).alias("places"), F.coalesce("first_docs", F.array().cast(f"array<{kind}>")).alias("first_docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                s = b.slice(k, _ROWS)
                doc, text, places, first = s.columns
                at = np.flatnonzero(np.diff(places.offsets.to_numpy()) > 0)
                removed, words = np.zeros(s.num_rows, np.int64), np.zeros(s.num_rows, np.int64)
                if len(at):
                    which = pa.array(at)
                    new, removed[at], words[at] = _without(text.take(which), places.take(which))
                    order = np.arange(s.num_rows)
                    order[at] = s.num_rows + np.arange(len(at))
                    text = pa.concat_arrays([text, new.cast(text.type)]).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([doc, text, pa.array(removed), pa.array(words), first], names=["doc", "text", "n_removed", "removed_words", "first_docs"])

    out = picked.mapInArrow(run, f"doc {kind}, text string, n_removed long, removed_words long, first_docs array<{kind}>")
    return out.select(F.col("doc").alias(id_col), "text", "n_removed", "removed_words", "first_docs")
