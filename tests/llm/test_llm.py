"""The training-data operators against SQL, brute force and their defined cases."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, deque

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_DIR
from sightings.llm import (
    chunk_tokens, common, components, exact_dedup, language_id, license_scan, line_templates, lz_fingerprint, packing, piece_codec,
    simhash, token_files, toxicity,
)
from sightings.llm.registry import ORACLES, QUERIES

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  a  b \n\n c ", "a\x1cb !\x1c! c", "it's I'LL  ", "<|endoftext|> a.,b İ ﬁ. A.́b ΑΣ", "\n", "\n\n", "a\n", "a \n b", "a\tb\t c\t",
    "Straße ñandú, ÀÉ. déjà ÿ", "\nfoo bar.\nBaz", "x　y ́z é", "▁ ▁▁a<s>0x", "🙂 ゼ中 \x00", "a.b, c!d... e",
]
LONG = "Permission is hereby granted, free of charge. " * 6000
# Names that the operators use inside, in another case too.
CLASHING = ["digest", "Keep_ID", "text_hash", "row", "part", "found", "judged", "LENGTH", "n_lines", "n_dropped", "key_id", "dropped", "score"]


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


def _rows(rows):
    return sorted((tuple(_value(v) for v in row) for row in rows), key=str)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(None, None), (None, "no id"), (1, ""), (2, " \n\t "), (3, "Same text here"), (3, "Same text here"), (3, "other"), (4, LONG), (5, "Same  text\nhere"), (6, None)]
    docs = spark.createDataFrame([(a, b, None, "s", None) for a, b in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def _tables(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# registered queries


def test_names():
    assert sorted(int(k[2 : k.index("_")]) for k in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    got = QUERIES[key](spark, SF_DIR)
    wanted = duck.execute(ORACLES[key])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.select(names).collect()) == _rows(wanted.fetchall())


def test_registered_in_entry():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


# 1 license scans


def test_license_joins_equal_brute_force(spark):
    rng = random.Random(1)
    words = "aa bb cc dd ee ff gg hh".split()
    templates = [("x", "aa bb cc dd ee"), ("y", "bb ff gg"), ("z", "hh"), ("x", "cc dd ee ff gg hh")]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(words + ["zz"], k=rng.randint(0, 40)))) for i in range(150)]
    step = license_scan.block_step(templates)
    assert step == 6
    for contained in (0.4, 0.7, 1.0):
        got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan(_tables(spark, rows), templates, contained).collect()}
        for i, text in rows:
            own = text.split()
            blocks = [set(own[k : k + 2 * step]) for k in range(0, len(own), step)]
            share = [(label, len(b & set(t.split())) / len(set(t.split()))) for b in blocks for label, t in templates]
            met = [(label, s) for label, s in share if s >= contained - 1e-9]
            assert got[i] == (",".join(sorted({label for label, _ in met})), round(max((s for _, s in met), default=0.0), 9))


def test_wrapped_notices_are_found(spark):
    """Notices as source files have them: with comment signs, broken at any column, in the midst of other words."""
    rng, rows = random.Random(9), []
    for label, notice in license_scan.TEMPLATES:
        for width in (20, 40, 72, 500):
            for mark in ("", " * ", "# "):
                around = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(0, 90))]
                text = " ".join(around) + "\n" + "\n".join(mark + line for line in textwrap.wrap(notice, width, break_long_words=False)) + "\n" + " ".join(around[::-1])
                rows.append((len(rows), label, text))
    got = {r.doc_id: r for r in license_scan.scan(_tables(spark, [(i, t) for i, _, t in rows])).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label, _ in rows)


def test_license_places(spark, edge):
    rows = [(1, "MIT\nLicense, mit-license MITlicense"), (2, "é general PUBLIC license general public"), (3, "KMIT license")]
    got = {r.doc_id: r for r in license_scan.scan(_tables(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (5, 2, 0, 2, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].score) == (1, 1, "gpl", 1.0)
    assert got[3].n_base == 0
    rows = license_scan.scan(edge).collect()
    assert len(rows) == 10 and {r.labels for r in rows if r.doc_id != 4} == {""}
    assert license_scan.scan(edge.limit(0)).count() == 0


# 2 language identification


def test_language_held_out_accuracy(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF_DIR).collect()}
    told = duck.execute("SELECT doc_id, lang FROM documents").fetchall()
    held = [(got[i], lang) for i, lang in told if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([r.lang_pred == lang for r, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(spark, edge):
    docs = edge.withColumn("lang", F.when(F.col("doc_id") == 3, "en"))
    model = language_id.fit(docs)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", language_id.identify(F.col("text"), shared).alias("x")).collect()
    assert {r.x.lang_pred for r in rows if not language_id.has_letter(r.text)} == {"und"}
    assert {r.x.lang_pred for r in rows if language_id.has_letter(r.text)} == ({"en"} if model.languages else {"und"})
    kept = language_id.drop_unknown(docs)
    assert kept.columns == docs.columns
    assert language_id.fit(edge).languages == [] and language_id.drop_unknown(edge.limit(0)).count() == 0


def test_sparse_weights_and_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = (rng.random((400, 50)) < 0.03) * 0.3
    x[:, 0] += y
    w, b = language_id.follow_the_leader(x, y, 2)
    assert (w[:, 1:] == 0).mean() > 0.3 and ((x @ w.T + b).argmax(1) == y).mean() > 0.95
    logits = rng.normal(size=(2000, 3)) * 4
    p = np.exp(logits / 2)
    drawn = np.array([rng.choice(3, p=r / r.sum()) for r in p])
    assert abs(language_id.fit_temperature(logits, drawn) - 2) < 0.3


# 3 token files


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        some = rng.random(n) < 0.05
        for values in (rng.integers(0, 49408, n), np.full(n, 7), rng.integers(0, 2**32, n), np.where(some, rng.integers(0, 2**32, n), rng.integers(100, 200, n))):
            payload, starts = token_files.pack_blocks(values.astype("<u4"))
            assert (token_files.read_blocks(payload, starts) == values).all() and len(starts) == -(-n // token_files.BLOCK)
    few = rng.integers(100, 116, 512)
    few[3] = 2**31
    payload, _ = token_files.pack_blocks(few.astype("<u4"))
    assert len(payload) < 512  # the outlier doesn't widen the block


def test_token_files(spark, texts, edge):
    library = Tokenizer.from_file(WORD_BPE)
    start = 0
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for shards, docs in ((3, edge), (1, edge), (4, edge.limit(0))):
        folder = f"{common.prepare(spark) and token_files.scratch_path(spark, 'token-test')}"
        token_files.write(docs, folder, WORD_BPE, shards=shards)
        back = token_files.read(spark, folder).orderBy("start").collect()
        assert [r.start for r in back] == [sum(x.n_tokens for x in back[:k]) for k in range(len(back))]
        assert len(back) == docs.count() and all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in back)
        assert [r.doc_id for r in back] == sorted((r.doc_id for r in back), key=lambda x: (x is not None, x))


def test_added_tokens_in_files_and_packs(spark):
    rows = [(1, "a <|endoftext|>b"), (2, "<|startoftext|>"), (3, "<|endoftext|><|endoftext|> x <|EndOfText|>"), (4, "plain")]
    library = Tokenizer.from_file(WORD_BPE)
    folder = f"{common.prepare(spark) and token_files.scratch_path(spark, 'token-test')}"
    token_files.write(_tables(spark, rows), folder, WORD_BPE, shards=2)
    for r in token_files.read(spark, folder).collect():
        assert list(r.ids) == [*library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 1]
    _check_packing(packing.pack_documents(_tables(spark, rows), BYTE_BPE).collect(), rows)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_chunks_equal_library(path, texts):
    encoder, library = chunk_tokens.ChunkEncoder(path, path == WORD_BPE, generation=50), Tokenizer.from_file(path)
    rng = random.Random(3)
    drawn = ["".join(rng.choice("aB .,!'s\n\t\x0b\x1c\xa0 éÉß中́🙂0 ") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "a", "Ab.", "\n", "é", "x  "]
    drawn += ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(1500)]
    some = [t or "" for _, t in texts[:40]] + ODD + drawn
    for text, ids in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


class _Asked:
    """A tokenizer that notes the chunks it is asked for."""

    def __init__(self, tokenizer):
        self.whole, self.chunks, self.model = tokenizer, [], self
        self.words = tokenizer.model

    def tokenize(self, word):
        return self.words.tokenize(word)

    def encode_batch_fast(self, chunks, **options):
        self.chunks += chunks
        return self.whole.encode_batch_fast(chunks, **options)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_words_with_marks_are_asked_once(path):
    words = ["".join(x) for x in zip("abcdefghij" * 5, "éfghijklmnopqrstuvwxyz" * 3, "nopqr" * 20)]
    some = ["".join(f" {w}{m}\n{w.upper()}{m}{m}" for w in words) for m in ("$$$", "&&", "%", ".#", ",*", ".", "-", "'s")]
    encoder, library = chunk_tokens.ChunkEncoder(path, path == WORD_BPE), Tokenizer.from_file(path)
    encoder.tokenizer = asked = _Asked(encoder.tokenizer)
    for text, ids in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked.chunks) < 2 * len(words)  # marks and borders of lines, not every word with every mark


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_cuts_over_bytes_equal_library(path):
    encoder, library = chunk_tokens.ChunkEncoder(path, path == WORD_BPE, generation=50), Tokenizer.from_file(path)
    white = [*chunk_tokens.WHITE, "\x1c", "\x1f", "\u200b", "\ufeff", "\u180e"]
    some = [f"a{x}b{x}{x}C {x}d\n{x}{x}e{x}" for x in white]
    some += [f"{a}{b}{c}" for a in ("H", "é", "ÿ", "3", "|", "\n", "") for b in ("\u0331", "\u0338", "'", "=\u0338", "<|endoftext|>", "\n", "×") for c in ("s", "LL", "É.", "")]
    some += ["<|EndOfText|>x<|endoftext|>Y<|STARTOFTEXT|>", "x" * 70_000 + " y", "\nA\n\nB\n \nC"]
    for text, ids in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    rows = [(k, None if k % 7 == 3 else text) for k, text in enumerate(some)]
    for size in (1, 40, 10**6):  # texts of Arrow batches, in runs that batches do not bound
        waiting = deque()
        batches = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x, pa.string())], ["doc_id", "text"])
                   for ids, x in (zip(*rows[k : k + 11], strict=True) for k in range(0, len(rows), 11))]
        runs = [*chunk_tokens.texts_of(iter([*batches, batches[0].slice(3, 4), batches[0].slice(0, 0)]), waiting, size)]
        assert [x for run in runs for x in run.to_pylist()] == [x or "" for _, x in [*rows, *rows[3:7]]]
        assert [*waiting] == [k for k, _ in [*rows, *rows[3:7]]]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_arrays(runs)]
        assert got == [library.encode(x or "", add_special_tokens=False).ids for _, x in [*rows, *rows[3:7]]]


# 4 Lempel-Ziv fingerprints


def _phrases(data: bytes) -> set[bytes]:
    seen, at = set(), b""
    for byte in data:
        at += bytes([byte])
        if at not in seen:
            seen.add(at)
            at = b""
    return seen


def _decoded(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def _check_prints(got, rows):
    assert len(got) == len(rows)
    told = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got}
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        prints = [lz_fingerprint.fingerprint(x) for x in (text, edited, following)]
        near = [round(lz_fingerprint.likeness(_decoded(prints[0]), _decoded(x)), 9) for x in prints[1:]]
        assert (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *near) in told


def test_lz_fingerprints(spark, texts, edge):
    _check_prints(QUERIES["op4_lz_fingerprint"](spark, SF_DIR).collect(), texts)
    rows = sorted(((r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for parts in (1, 3, 16):
        _check_prints(lz_fingerprint.lz_fingerprints(edge, parts).collect(), rows)
    assert lz_fingerprint.lz_fingerprints(edge.limit(0), 3).count() == 0


def test_lz_likeness_estimates_phrase_sets(texts):
    off = []
    for (_, a), (_, b) in zip(texts[:60], texts[1:61], strict=True):
        b = a[: len(a) // 2] + b
        p, q = _phrases(a.encode()), _phrases(b.encode())
        near = lz_fingerprint.likeness(_decoded(lz_fingerprint.fingerprint(a)), _decoded(lz_fingerprint.fingerprint(b)))
        off.append(abs(near - len(p & q) / len(p | q)))
    assert np.mean(off) < 0.05 and lz_fingerprint.likeness(_decoded(""), _decoded("")) == 1.0


# 5 pieces


def test_pieces_equal_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.PieceCodec(PIECES, generation=50)
    rng = random.Random(2)
    drawn = ["".join(rng.choice("ab  \n\t,.éß中ゼ▁\x00　🙂<s>0x") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    some = ODD + drawn + [t or "" for _, t in texts[:40]]
    told = library.encode(some, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)] == told
    got = {r.doc_id: r for r in QUERIES["op5_piece_codec"](spark, SF_DIR).collect()}
    for i, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        wanted = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == wanted


def test_pieces_whole_text_and_check():
    codec = piece_codec.PieceCodec(PIECES)
    codec.cuts = False  # as for a vocabulary whose pieces cross words
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(ODD)] == codec.library.encode(ODD, add_bos=True, add_eos=True)
    assert codec.differences == 0
    for cuts in (True, False):
        codec = piece_codec.PieceCodec(PIECES)
        codec.cuts = cuts
        codec.pieces["▁qq"] = (5, 9.0)
        some = ["a qq", "a b", "qq", "a qq"]
        for _ in range(2):  # what differs is not remembered
            assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)] == codec.library.encode(some, add_bos=True, add_eos=True)
        assert codec.differences == 6


def test_pieces_cases(spark, edge):
    rows = edge.select("text", piece_codec.decode(piece_codec.encode(F.col("text"), PIECES), PIECES).alias("back")).collect()
    assert [r.back for r in rows] == [r.text or "" for r in rows]
    assert piece_codec.round_trip(edge.limit(0), PIECES).count() == 0


# 6 line templates


def test_recurring_lines(spark, edge):
    rows = [(i, f"Posted by user{i} on day {i % 3}\nown alpha{chr(97 + i)} beta{chr(97 + i)} gamma\n\nfoot note") for i in range(6)]
    got = {r.doc_id: r for r in line_templates.drop_recurring(_tables(spark, rows + [(9, "foot note"), (10, None)])).collect()}
    assert got[0].text == "own alphaa betaa gamma\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert (got[9].text, got[9].n_dropped, got[10].text, got[10].n_lines) == ("", 1, "", 1)
    docs = edge.drop("n_lines", "n_dropped")
    cleaned = line_templates.drop_recurring(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_dropped"] and cleaned.count() == 10
    assert line_templates.drop_recurring(edge).columns[-2:] == ["n_lines_", "n_dropped_"]
    assert line_templates.drop_recurring(edge.limit(0)).count() == 0


def test_digit_lines_and_skewed_fields(spark, duck):
    """Digits recur as fields or word for word; a rare value beside a frequent one is a field, in a leading place too."""
    common = "Page {i}\nTel 030 1234567 Fax 030 1234568\n030 55 / 7\nposted by admin on day {i} at home\nno way"
    docs = [(i, common.format(i=i)) for i in range(200)]
    docs += [(200, "posted by bob on day 9 at home\nposted by admin on day 7 at work\nposted by bob on day 9 at work\n030 55 / 8\nPage one")]
    docs += [(201, " 030\t55 / 7 \n<*> 4\n7\npage 9\nno war\nposted by admin on day 3 at home now"), (202, "7\n7"), (203, None)]
    frame = _tables(spark, docs)
    got = {r.doc_id: r for r in line_templates.drop_recurring(frame).collect()}
    assert all(got[i].text == "" and got[i].n_dropped == 5 for i in range(200))
    assert got[200].text == "posted by bob on day 9 at work\nPage one" and got[203].n_lines == 1
    assert got[201].text == "<*> 4\n7\npage 9\nno war\nposted by admin on day 3 at home now" and got[202].text == "7\n7"
    local = duck.cursor()
    local.register("own_rows", frame.toPandas())
    wanted = local.execute(line_templates.OP6_SQL.replace("FROM documents", "FROM own_rows")).fetchall()
    assert _rows(wanted) == _rows((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.values())


def test_lines_of_many_templates(spark, duck):
    """Random lines over few words: every rule against the SQL."""
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(["ab", "cd", "ef", "7", "<*>", "x1"]) for _ in range(rng.randint(1, 5)))
    lines = [line() for _ in range(300)]
    docs = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else line() for _ in range(12))) for i in range(60)]
    frame = _tables(spark, docs)
    local = duck.cursor()
    local.register("own_rows", frame.toPandas())
    wanted = local.execute(line_templates.OP6_SQL.replace("FROM documents", "FROM own_rows")).fetchall()
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring(frame).collect()]
    assert _rows(got) == _rows(wanted) and 0 < sum(r[3] for r in got) < 720


# 7 toxicity


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    model = toxicity.Field(follow=rng.normal(size=(2, 2)))
    sizes = np.array([1, 4, 3, 6])
    emission, starts = rng.normal(size=sizes.sum()) * 2, np.cumsum(np.r_[0, sizes[:-1]])
    marginal, pairs = model.chains(emission, starts, sizes, expect=True)
    expected = np.zeros((2, 2))
    for start, size in zip(starts, sizes, strict=True):
        total, by_token, by_pair = 0.0, np.zeros(size), np.zeros((2, 2))
        for code in range(2**size):
            tags = [code >> k & 1 for k in range(size)]
            weight = math.exp(sum(emission[start + k] * t for k, t in enumerate(tags)) + sum(model.follow[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            by_token += weight * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                by_pair[a, b] += weight
        assert np.allclose(marginal[start : start + size], by_token / total)
        expected += by_pair / total
    assert np.allclose(pairs, expected)


def test_toxic_words_generalise():
    rng = random.Random(5)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]

    def text(bad):
        words = rng.choices(plain, k=60)
        if bad:
            words[rng.randrange(60)] = rng.choice(["scoundrel", "villain", "grobian" + rng.choice("abcdef")])
        return " ".join(words[:30]) + ". " + " ".join(words[30:])

    model = toxicity.train([text(True) for _ in range(120)], [text(False) for _ in range(300)])
    scorer = toxicity.Scorer(model)
    scores = [s for s, _ in scorer.score([text(True) for _ in range(50)] + [text(False) for _ in range(50)])]
    assert np.mean(np.array(scores[:50]) >= 0.5) > 0.95 and np.mean(np.array(scores[50:]) >= 0.5) < 0.05
    sample = "Wak wbl, grobianz wcm."
    (score, spans), *rest = scorer.score([sample, "", "?! ..", "scoundrel"])
    assert [sample[a:b] for a, b, _ in spans] == ["grobianz"] and score >= 0.5
    assert [s for s, _ in rest][:2] == [0.0, 0.0] and rest[2][0] >= 0.5


def test_toxicity_query_and_cases(spark, edge):
    got = QUERIES["op7_toxicity"](spark, SF_DIR).collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    labels = spark.createDataFrame([(3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.drop_toxic(edge, labels)
    assert kept.columns == edge.columns and kept.count() == 10  # nothing to learn from: nothing is toxic
    assert toxicity.drop_toxic(edge.limit(0), labels.limit(0)).count() == 0


def test_toxicity_sample(spark):
    """Labels of missing, empty or held-out documents take no place; long texts give a passage, a hot id one text."""
    bad = {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5}
    there = sorted(bad)[:300]
    long = "Some words here. " * 5000
    rows = [(i, long if i % 2 else "short text") for i in there] + [(there[0], f"copy {k}") for k in range(500)] + [(i, " ") for i in sorted(bad)[300:400]]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(1000)], "doc_id bigint, quality int, toxic int")
    got = toxicity.sample(_tables(spark, rows), labels, 60, 120).collect()
    assert sum(r.toxic for r in got) == 60 and len(got) == len({r.doc_id for r in got}) == 180 and {r.doc_id for r in got} <= set(there)
    assert all(len(r.text) <= toxicity.SAMPLE_CHARS and (r.text.endswith(".") if r.doc_id % 2 and r.doc_id != there[0] else True) for r in got)
    assert any(len(r.text) > 10_000 for r in got)


def test_toxic_words_in_texts_without_stops():
    rng = random.Random(7)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]

    def text(bad):
        words = rng.choices(plain, k=toxicity.SENTENCE + 150)
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "villain"])
        return " ".join(words)

    model = toxicity.train([text(True) for _ in range(60)], [text(False) for _ in range(120)])
    scores = np.array([s for s, _ in toxicity.Scorer(model).score([text(True) for _ in range(30)] + [text(False) for _ in range(30)])])
    assert model.trained and (scores[:30] >= 0.5).mean() > 0.95 and (scores[30:] >= 0.5).mean() < 0.05
    starts, sizes = toxicity._cut(np.array([0, 5, 20]), np.array([4, 10, 5]), 5)
    assert starts.tolist() == [0, 5, 10, 20] and sizes.tolist() == [4, 5, 5, 5]


# 8 packing


def test_best_fit_equals_single_pieces():
    rng = random.Random(3)
    for trial in range(200):
        capacity = rng.choice([10, 37, 2048])
        sizes = [rng.choice([3, 5, capacity // 2, capacity]) if trial % 3 == 0 else rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        placed, bins = packing.best_fit(Counter(sizes), capacity)
        rooms, wanted = [], 0
        for size in sorted(sizes, reverse=True):
            at = bisect.bisect_left(rooms, size)
            wanted += at == len(rooms)
            room = capacity if at == len(rooms) else rooms.pop(at)
            if room > size:
                bisect.insort(rooms, room - size)
        fill: dict[int, list] = {}
        for size, _, pieces, each, first, offset in placed:
            for k in range(pieces):
                fill.setdefault(first + k // each, []).append((offset + k % each * size, size))
        assert bins == wanted == len(fill) and Counter(s for x in fill.values() for _, s in x) == Counter(sizes)
        for content in fill.values():
            at = 0
            for offset, size in sorted(content):
                assert offset == at
                at += size
            assert at <= capacity


def _check_packing(got, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    wanted = Counter()
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) % 2048 or min(len(ids), 2048)
        begins = [0, *range(cut, len(ids), 2048)]
        for piece, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
            wanted[(i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    fill: dict[int, list] = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in fill.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    return len(fill)


def test_packing(spark, texts, edge):
    got = QUERIES["op8_best_fit_packing"](spark, SF_DIR).collect()
    assert _check_packing(got, texts) <= -(-sum(r.length for r in got) // 2048) + 2
    own = packing.pack_documents(edge, BYTE_BPE).collect()
    _check_packing(own, [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    assert packing.pack_documents(edge.limit(0), BYTE_BPE).count() == 0


# 9 SimHash


def _brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _brute_components(prints: list[int], radius: int) -> list[int]:
    """For each print the place of the first of its component."""
    a, label = np.array(prints, np.uint64), list(range(len(prints)))
    for i in range(len(a)):
        todo = [i] if label[i] == i else []
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(a[at] ^ a) <= radius):
                if label[j] == j and j > i:
                    label[j] = i
                    todo.append(j)
    return label


def test_simhash_query(spark, texts):
    prints = [_brute_fingerprint(t) for _, t in texts]
    first = _brute_components(prints, 4)
    wanted = {(i, f"{p:016x}", texts[k][0]) for (i, _), p, k in zip(texts, prints, first, strict=True)}
    assert {tuple(r) for r in QUERIES["op9_simhash"](spark, SF_DIR).collect()} == wanted


@pytest.mark.parametrize("radius", [1, 4])
def test_covering_misses_no_pair(radius):
    rng = np.random.default_rng(6)
    for kept in (0, simhash.masks(list(range(64)), radius)[2]):
        tables = simhash._tables(kept, radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        free = [b for b in range(64) if not kept >> b & 1]
        for _ in range(2000):
            differ = sum(1 << int(b) for b in rng.choice(free, rng.integers(1, radius + 1), replace=False))
            assert any(not differ & m for m in tables)


def test_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    near = [0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(600)]
    prints = sorted({*near, *map(int, rng.integers(0, 2**63, 100))})
    docs = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(prints)], "doc_id bigint, print bigint")
    first = _brute_components(prints, 4)
    for bucket in (2000, 20):
        assert {(r.doc_id, r.component_id) for r in simhash.label(docs, 4, bucket).collect()} == set(enumerate(first))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_simhash_cases(spark, edge):
    got = simhash.label(simhash.fingerprints(edge)).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.print == 0} == {1}
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=str) == sorted(
        [(None, "no id"), (1, ""), (3, "Same text here"), (3, "other"), (4, LONG)], key=str
    )
    assert simhash.drop_near_copies(edge.limit(0)).count() == 0


# 10 exact dedup


def test_exact_dedup_batches(spark, edge):
    rows = [(i, f"text {i % 7}" if i % 3 else f"text\t {i % 7}") for i in range(50)]
    wanted = sorted((i, i % 7, 8 if i % 7 == 0 else 7, i < 7) for i, _ in rows)
    for batches in (1, 2, 5):
        got = exact_dedup.deduplicate(spark, _tables(spark, rows), batches=batches).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == wanted
    index = exact_dedup.DigestIndex(spark, buckets=8)
    exact_dedup.deduplicate(spark, _tables(spark, rows[:10]), index)
    got = exact_dedup.deduplicate(spark, _tables(spark, [(100, "text 1"), (101, "new"), (102, "new")]), index).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(100, 1, False), (101, 101, True), (102, 101, False)]
    assert index.read().count() == 8
    other = spark.newSession()
    for buckets in (16, 3, 8):  # an index that is opened again has its own buckets, whatever is asked for
        again = exact_dedup.DigestIndex(common.prepare(other), index.path, buckets)
        got = exact_dedup.deduplicate(other, other.createDataFrame([(200 + i, t) for i, t in rows[:10]], "doc_id bigint, text string"), again).collect()
        assert again.buckets == 8 and not any(r.kept for r in got) and again.read().count() == 8
    again.rewrite(5)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.version, again.buckets, again.read().count(), len(again.read().inputFiles()) <= 5) == (1, 5, 8, True)
    for turn in range(exact_dedup.APPENDS + 2):  # many appends are brought back to a file a bucket
        new = spark.createDataFrame([(1000 * turn + k, f"batch {turn} {k}") for k in range(40)], "doc_id bigint, text string")
        assert all(r.kept for r in exact_dedup.deduplicate(spark, new, again, batches=1).collect())
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.version > 1 and again.read().count() == 8 + 40 * (exact_dedup.APPENDS + 2) == again.read().distinct().count()
    assert not any(r.kept for r in exact_dedup.deduplicate(spark, new, again).collect())
    plan = index.new(exact_dedup.first_rows(exact_dedup.digests(_tables(spark, rows))))._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_exact_dedup_cases(spark, edge):
    got = exact_dedup.deduplicate(spark, edge).collect()
    assert len(got) == 10 and sum(r.kept for r in got) == 6
    assert {r.keep_id for r in got if r.group_size == 3 and r.doc_id in (None, 1, 6)} == {1}
    kept = exact_dedup.drop_copies(spark, edge)
    assert kept.columns == edge.columns
    assert sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=str) == sorted(
        [(None, "no id"), (1, ""), (2, " \n\t "), (3, "Same text here"), (3, "other"), (4, LONG)], key=str
    )
    assert exact_dedup.deduplicate(spark, edge.limit(0)).count() == 0 and exact_dedup.drop_copies(spark, edge.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = common.documents(spark, SF_DIR).withColumn("digest", F.lit(1))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name == "packing":
            _check_packing(out.collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
            break
        out = corpus_pipeline.staged(out, "stage")
        assert out.columns == docs.columns and ids(out) <= ids(docs) and out.count() == len(ids(out))
        gone = {r.doc_id: r.text for r in docs.collect()}
        before = {k: v for k, v in gone.items()}
        for i in ids(out):
            del gone[i]
        if name == "language_id":
            assert not any(language_id.has_letter(t) for t in gone.values())
        elif name == "toxicity":
            bad = {r.doc_id for r in labels.where("toxic = 1").collect()} & set(before)
            assert len(bad & set(gone)) >= 0.8 * len(bad) and len(gone) < 0.3 * len(before)
        elif name == "exact_dedup":
            normal = {k: re.sub(r"[\x20\x09-\x0D]+", " ", v or "") for k, v in before.items()}
            assert ids(out) == {min(k for k in normal if normal[k] == t) for t in set(normal.values())}
        else:
            own = sorted(before)
            first = _brute_components([_brute_fingerprint(before[k]) for k in own], 4)
            assert ids(out) == {own[k] for k in first}
        docs = out


def test_pipeline_of_odd_rows(spark, edge, tmp_path):
    for docs in (edge, edge.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR), "odd")
        assert docs.count() in (0, 1) or docs.count() > 3


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
