from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quireframe.llm import substring_dedup, token_store
from quireframe.llm.common import tokenizer_path

from .conftest import prose


MASK = (1 << 64) - 1
RANGES = "".join(f"{chr(a)}-{chr(b)}" for a, b in substring_dedup.DENSE)
SLOW_WORD = re.compile(rf"[{RANGES}]|[^ \t\n\x0b\x0c\r{RANGES}]+")


def slow_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def slow_mark(word):
    h = len(word)
    for i in range(4):
        for b in (word[min(i, len(word) - 1)], word[max(len(word) - 1 - i, 0)]):
            h = (h * 0x9E3779B97F4A7C15 + b) & MASK
    return h


def slow_sentences(text):
    """[(piece, lower-case words in bytes)], word by word; the pieces join to the text."""
    found = list(SLOW_WORD.finditer(text))
    if not found:
        return []
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in m[0].encode()) for m in found]
    new = [0]
    for i in range(1, len(found)):
        before = found[i - 1][0]
        stop = before[-1] in ".!?" or (len(before) > 1 and before[-1] in "\"')]}" and before[-2] in ".!?") or ord(before[-1]) in substring_dedup.DENSE_STOPS
        if stop or "\n" in text[found[i - 1].end() : found[i].start()]:
            new.append(i)
    cuts = set(new)
    for a, z in zip(new, [*new[1:], len(found)], strict=True):
        if z - a > 15:
            pair = [slow_mix((slow_mark(x) * 0x9E3779B97F4A7C15 + slow_mark(y)) & MASK) for x, y in zip(words[a:z], words[a + 1 : z], strict=False)]
            for i in range(len(pair) - 7):
                least = min(pair[i : i + 8])
                cuts.add(a + 1 + max(k for k in range(i, i + 8) if pair[k] == least))
    at = sorted(cuts)
    edges = [0, *[found[i].start() for i in at[1:]], len(text)]
    return [(text[p:q], words[a:z]) for p, q, a, z in zip(edges, edges[1:], at, [*at[1:], len(found)], strict=False)]


def test_sentences_are_those_of_the_slow_way():
    rng = random.Random(4)
    texts = [prose(rng, 200), "no end", "...!!\n\n", " a. b?  c!\nd " + "w " * 100, "x" * 50, "", " \n\t ", 'He said "no." Then (ha!) left.\n\nEnd']
    texts += ["这是第一句。第二句！" * 9 + "混合 mixed text，ok？", "ไทยไม่มีช่องว่าง " * 3, "İ \x1c ẞ\u3000x " * 9, "\U00020000\U0001f600. b"]
    texts += ["".join(rng.choice("ab .!?\n\"'é中。") for _ in range(rng.randrange(90))) for _ in range(300)]
    texts += ["  " + " \t".join(words) + "\x1c " for words in (bare(rng, 16), bare(rng, 400), ["w"] * 100, ["İ", "x", "ẞ"] * 9)]
    at = substring_dedup.layout(pa.array(["skipped", *texts])[1:])
    raw = bytes(at.data)
    words = [raw[a:b] for a, b in zip(at.start.tolist(), at.end.tolist(), strict=True)]
    for i, text in enumerate(texts):
        slow = slow_sentences(text)
        assert "".join(p for p, _ in slow) == text or not slow
        got = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words[at.first[s] : at.first[s + 1]]] for s in range(at.begins[i], at.begins[i + 1])]
        assert got == [w for _, w in slow], text


def test_removes_repeated_passages_and_leaves_the_rest(spark):
    rng = random.Random(8)
    passage = prose(rng, 70).replace("\n", " ")
    rows = [(i, prose(rng, 60)) for i in range(40)]
    for i in (3, 9, 21, 30):
        rows[i] = (i, prose(rng, 31) + ". " + passage + ". " + prose(rng, 25))
    rows += [(50, rows[0][1]), (51, "Same short text."), (52, "Same short text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs.repartition(5)).collect()}
    before = dict(rows)
    changed = {i for i, r in got.items() if r["text"] != before[i]}
    assert changed == {9, 21, 30, 50}
    assert got[50]["text"] == "" and got[50]["first_docs"] == [0]
    for i in (9, 21, 30):
        left = got[i]["text"]
        assert " ".join(passage.split()[10:60]) not in " ".join(left.split())
        assert before[i][:100] == left[:100] and got[i]["removed_words"] >= 60
        assert set(got[i]["first_docs"]) == {3}


def bare(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(n)]


def test_passages_are_found_at_any_offset(spark):
    rng = random.Random(21)

    def hashes(words):
        _, _, _, h1, h2, _, longer = substring_dedup.spans(pa.array([" ".join(words)]), 2, 20)
        return {*zip(h1.tolist(), h2.tolist(), strict=True), *longer.tolist()}

    for n in (51, 55, 60, 67):
        for stops in ((), (25,), (20, 34), (16, 30, 46), (14, 36), (15, 35)):
            passage = [w + "." * (i in stops) for i, w in enumerate(bare(rng, n))]
            for before in range(32):
                there = hashes(bare(rng, 7) + passage + bare(rng, 40))
                assert there & hashes(bare(rng, before) + passage + bare(rng, rng.randrange(40))), (n, stops, before)
    passage = bare(rng, 60)
    rows = [(i, " ".join(bare(rng, 11 * i + 3) + passage + bare(rng, 50))) for i in range(6)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    for i in range(1, 6):
        gone = set(rows[i][1].split()) - set(got[i]["text"].split())
        assert 0 in got[i]["first_docs"] and len(gone & set(passage)) >= 30 and gone <= set(passage)


def test_pieces_of_long_sentences():
    rng = random.Random(22)
    for words in (bare(rng, 16), bare(rng, 400), ["w"] * 100):
        sizes = np.diff(substring_dedup.layout(pa.array([" ".join(words)])).first)
        assert sizes.sum() == len(words) and 0 < sizes.min() and sizes.max() <= 8


def text_key(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) - (xxhash.xxh64_intdigest(text.encode(), 42) >> 63 << 64)


def all_runs_removed(rows):
    """Sentences covered by any but the first occurrence of any run of 2+ sentences and 20+ words, over distinct (id, text)."""
    first, covered = {}, {}
    for d, k, t in sorted({(d, text_key(t), t) for d, t in rows if t}):
        parts = [tuple(w) for _, w in slow_sentences(t)]
        for start in range(len(parts)):
            for end in range(start + 2, len(parts) + 1):
                run = tuple(parts[start:end])
                if sum(map(len, run)) >= 20 and first.setdefault(run, (d, k, start)) != (d, k, start):
                    covered.setdefault((d, t), set()).update(range(start, end))
    return covered


def test_equals_brute_force_over_all_runs(spark):
    rng = random.Random(23)
    line = lambda n: " ".join(bare(rng, n)) + "."
    closing = [line(n) for n in (12, 12, 5)]
    rows = [(i, " ".join([line(12), *closing, line(12)])) for i in range(3)]
    stock = [line(rng.randrange(1, 15)) for _ in range(30)]
    for i in range(3, 60):
        at = rng.randrange(25)
        rows.append((i, " ".join([line(rng.randrange(1, 15)), *stock[at : at + rng.randrange(2, 6)], line(rng.randrange(1, 15))])))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = all_runs_removed(rows)
    assert got[1] == got[2] == 3
    assert got == {d: len(want.get((d, t), ())) for d, t in rows}


def test_whole_result_equals_brute_force(spark):
    rng = random.Random(11)
    stock = [prose(rng, rng.randrange(5, 40)).replace("\n", " ") + "." for _ in range(12)] + ["这是一个没有空格的句子" + "重复的段落内容很长很长。" * 3]
    rows = [(i % 60 if i % 9 else None, " ".join(rng.choice(stock) if rng.random() < 0.5 else prose(rng, 15) for _ in range(rng.randrange(1, 6)))) for i in range(90)]
    rows += [rows[4], (7, ""), (8, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = all_runs_removed([(-1 if d is None else d, t) for d, t in rows])
    slow = []
    for d, t in rows:
        gone = want.get((-1 if d is None else d, t), ())
        parts = slow_sentences(t or "")
        left = "".join(p for i, (p, _) in enumerate(parts) if i not in gone) if gone else t
        slow.append((d, left, len(gone), sum(len(parts[i][1]) for i in gone)))
    order = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"], r["n_removed"], r["removed_words"]) for r in got), key=order) == sorted(slow, key=order)


def test_substring_query_equals_brute_force(spark):
    """The query itself over all of the smallest table, with the shortest runs from and to every sentence, which cover all longer ones."""
    from quireframe.llm.queries import op7_substring_dedup

    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    first, covered = {}, {}
    for d, t in docs:
        parts = [tuple(w) for _, w in slow_sentences(t)]
        upto = np.append(0, np.cumsum([len(w) for w in parts]))
        ends, starts = {}, {}
        for i in range(len(parts)):
            long = [e for e in range(i + 2, min(len(parts), i + 22) + 1) if upto[e] - upto[i] >= 20]
            if long:
                ends[i] = long[0]
        for e in range(2, len(parts) + 1):
            long = [i for i in range(max(0, e - 22), e - 1) if upto[e] - upto[i] >= 20]
            if long:
                starts[e] = long[-1]
        for i, e in sorted({*ends.items(), *((i, e) for e, i in starts.items())}):
            run = tuple(parts[i:e])
            if first.setdefault(run, (d, i)) != (d, i):
                covered.setdefault(d, set()).update(range(i, e))
    got = op7_substring_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "text", "n_removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {d: r["n_removed"] for d, r in rows.items()} == {d: len(covered.get(d, ())) for d, _ in docs}
    for d, t in docs:
        left = "".join(p for i, (p, _) in enumerate(slow_sentences(t)) if i not in covered.get(d, ()))
        assert (rows[d]["text"] or "") == (left if d in covered else t)


def test_token_query_equals_the_tokenizer(spark):
    """The query itself over all of the smallest table: starts, counts and checksums."""
    from tokenizers import Tokenizer

    from quireframe.llm.queries import op9_tokens

    t = Tokenizer.from_file(tokenizer_path())
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, start = [], 0
    for d, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = op9_tokens(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("hot", [1, 10**9])
def test_hot_spans_are_dealt_out(spark, hot):
    rng = random.Random(31)
    line = lambda n: " ".join(bare(rng, n)) + "."
    common = " ".join(line(9) for _ in range(4))
    rows = [(i, f"{line(8)} {common} {line(7)}") for i in range(120)] + [(None, common), (None, common), (500, line(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs, hot=hot, parts=8).collect()
    want = all_runs_removed([(-1 if d is None else d, t) for d, t in rows])
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == sorted((str(d), len(want.get((-1 if d is None else d, t), ()))) for d, t in rows)
    assert all(f is None or f < r["doc_id"] for r in got for f in r["first_docs"] if r["doc_id"] is not None)


def test_text_without_blanks_is_deduplicated(spark):
    text = "".join(f"第{chr(0x4E00 + i)}句话没有任何空格{chr(0x5E00 + i * 3)}。" for i in range(60))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, "开头不同。" + text)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["text"], got[1]["text"], got[1]["first_docs"]) == (text, "开头不同。", [1])


def test_substring_odd_rows(odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs)
    assert got.count() == odd_docs.count()
    assert {r["text"] for r in got.where("doc_id = 2").collect()} == {None}
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 300, 49_408, 2**32])
def test_segment_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, top, n), rng.integers(0, max(1, top // 500), n)).astype(np.uint32)
    lengths = np.array([n // 2, n - n // 2, 0], np.int64)
    data = token_store.write_segment(ids, lengths)
    got, sizes = token_store.read_segment(data)
    assert got.tolist() == ids.tolist() and sizes.tolist() == lengths.tolist()
    if n > 1024:
        assert token_store.read_blocks(data, 1, 2).tolist() == ids[1024:2048].tolist()


ODD = ["It's 'tis don't “x”, a.b, c.. d., .e ,f  g", "ÀÉ straße İI ΣΑΣ ẞ é. ﬁ", "a\x1cb\x1f c\xa0d\x85e　f", "<|endoftext|> <|x|>.", "\U0001f600. ​, ...", ", . ,", "1234.5, 6", "", None, "Word. " * 3]


@pytest.mark.parametrize("special", [False, True])
def test_encoding_by_pieces_equals_the_tokenizer(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = special
    rng = random.Random(6)
    texts = ODD + [prose(rng, 300) for _ in range(5)] + ["".join(rng.choice("ab .,'’\n\té\xa0!ЖΣ中") for _ in range(60)) for _ in range(300)]
    encode = token_store.Encoder(tokenizer_path(), special)
    for _ in range(2):  # unseen words, then remembered ones
        ids, sizes = encode(pa.array(["skipped", *texts])[1:])
        assert len(sizes) == len(texts) and sizes.sum() == len(ids)
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_a_cased_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert token_store.splits_into_words(tokenizer_path()) and not token_store.splits_into_words(path)
    ids, sizes = token_store.Encoder(path)(pa.array([*ODD, "Mixed Case  text"]))
    for text, got in zip([*ODD, "Mixed Case  text"], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, text


def test_files_hold_what_was_written(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    path = token_store.write(odd_docs.repartition(6), tokenizer_path(), segment=2000)
    got = token_store.read(spark, path).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    encoded = sorted(t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows)
    assert sorted(r["ids"] for r in got) == encoded
    assert token_store.index(spark, token_store.write(no_docs, tokenizer_path())).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns; then no rows at all."""
    import corpus_pipeline

    rng = random.Random(41)
    stock = {"xx": "bar zim lor tuk fen gal".split(), "yy": "ostra velin madu kepo siri nul".split()}
    rows = [(i, prose(rng, 40 + i % 30, stock["xx" if i % 2 else "yy"]), "xx" if i % 2 else "yy", f"s{i % 3}", 1, "a", 1) for i in range(80)]
    leak = prose(rng, 30, stock["xx"])
    rows += [rows[3], rows[3], (None, prose(rng, 50, stock["xx"]), None, None, None, None, None), (None, None, None, None, None, None, None), (200, "", "xx", "s1", 0, "", 0), (201, "12 ½", "xx", None, 0, "", 0)]
    rows += [(202, prose(rng, 20, stock["yy"]) + " " + leak, "yy", "s1", 1, "b", 1), (203, prose(rng, 9_000, stock["yy"]), "yy", None, 1, "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, row int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert not {200, 201} & set(ids) and (i < 1 or i == 3 or ids.count(3) == 1) and (i < 2 or 202 not in ids)
        assert i == 3 or (None in ids and 203 in ids)  # the mixture may leave either out
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(map(str, ids))
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    none = str(tmp_path / "none")
    spark.createDataFrame([], schema).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.shared_dir(spark, "stage")
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == docs.count() and kept > 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == out.count()
