import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from changelens.llm import catalog, memo, pieces, token_files
from changelens.session import work_dir
from tests.llm.conftest import SF

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "a", "don't we'LL 'tis x''s 's's ''", "it's<|endoftext|>x", "Été ÄÖÜ ß × ÷ a×b", "ć ́x é", "ΟΔΟΣ İ ǅ", "x\x1cy\x85z w v", "▁a ▁ b▁▁ c", "  two   three    ", "a\n\n b \t\nc",
        "x" * 3000, "a\x00b a\x00 a", "\U0001f600‍\U0001f600", "12 345 6789", "!!! ... ?!", "ﬁ ① ﷺ", "abcdefgh abcdefghijklmnop abcdefghijklmnopq", "<s> </s> <unk> <0x0A>"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    signs = "aabcdeSTLMDrev''  \n\t.,!?-<|>09éÉß×▁́中\U0001f600"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(documents):
    return [r["text"] for r in documents] + HARD + random_texts(500)


def test_word_ids_as_of_the_library(texts):
    library = tokenizers.Tokenizer.from_file(WORDS)
    got = token_files.WordEncoder(WORDS).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_piece_ids_as_of_the_library(texts):
    mine = pieces.Pieces(PIECES)
    for t, (ids, places) in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == mine.library.encode(t), t
        assert places[0] == 0 and places[-1] == len(t.encode()) and (np.diff(places) >= 0).all()


def test_memory_that_forgets_gives_the_same(texts, monkeypatch):
    want = [i.tolist() for i, _ in pieces.Pieces(PIECES).encode(texts)]
    monkeypatch.setattr(memo, "ENTRIES", 50)
    monkeypatch.setattr(memo, "TOGETHER", 300)
    assert [i.tolist() for i, _ in pieces.Pieces(PIECES).encode(texts)] == want


def test_spans_hold_what_the_pieces_say():
    mine = pieces.Pieces(PIECES)
    for t in HARD[5:12]:
        raw = t.encode()
        for i, (a, b) in zip(mine.encode([t])[0][0], zip(mine.encode([t])[0][1][:-1], mine.encode([t])[0][1][1:], strict=True), strict=True):
            piece, kind = mine.pieces[i]
            if kind == pieces.NORMAL and "▁" not in t:
                assert piece.replace("▁", " ").lstrip(" ") == raw[a:b].decode().lstrip(" ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisation_by_the_compiled_map(rule, tmp_path, texts):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    if rule == "identity":
        return
    blob = theirs.serialized_model_proto()
    path = tmp_path / "m.model"
    spec = next(whole for n, _, _, whole in pieces._fields(blob) if n == 3)
    rest = b"".join(whole for n, _, _, whole in pieces._fields(open(PIECES, "rb").read()) if n != 3)
    path.write_bytes(rest + spec)
    mine = pieces.Pieces(str(path))
    assert mine.map.units
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for t in texts[-400:] + HARD:
        normal, where = mine.normalize(t.encode())
        want, offsets = theirs.normalize(t, with_offsets=True) if t else ("", [0])
        assert normal.decode().replace("▁", " ") == want.replace("▁", " "), t
        assert mine.encode([t])[0][0].tolist() == library.encode(t), t
        # the library counts in code points of both texts
        ends = np.append(0, np.cumsum([len(c.encode()) for c in normal.decode()])).astype(int)
        points = np.append(0, np.cumsum([len(c.encode()) for c in t])).tolist()
        if t.strip() and len(offsets) == len(ends):
            assert [points.index(p) for p in where[ends].tolist()] == list(offsets), t


def test_token_file_query(spark, documents):
    library, at = tokenizers.Tokenizer.from_file(WORDS), 0
    got = {r["doc_id"]: r for r in catalog.op2_token_files(spark, SF).collect()}
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_of_odd_rows(spark, odd, empty):
    folder = work_dir(spark, "tokens")
    manifest = token_files.write_ids(odd, folder, WORDS, 2)
    rows = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["start"] == 0
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = sorted(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in odd.collect())
    assert sorted(bytes(r["ids"]) for r in rows) == want
    assert manifest.agg(F.sum("n_docs")).first()[0] == odd.count()
    folder = work_dir(spark, "tokens")
    token_files.write_ids(empty, folder, WORDS, 2)
    assert token_files.read_ids(spark, folder).collect() == []


def test_piece_query(spark, documents, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in catalog.op9_sentencepiece(spark, SF).collect()}
    for r in documents:
        ids = library.encode(r["text"] or "", add_eos=True)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), True)
    rows = pieces.encode_texts(odd, PIECES).collect()
    assert sorted(r["ids"] for r in rows) == sorted(library.encode(r["text"] or "", add_eos=True) for r in odd.collect())
    assert all(len(r["places"]) == len(r["ids"]) for r in rows)
    assert pieces.encode_texts(empty, PIECES).collect() == []


def test_texts_encoded_together_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "SOURCE", 10)
    monkeypatch.setattr(pieces, "TEXTS", 3)
    cuts = lambda *sizes: list(pieces._cuts(pa.array([None if n is None else "x" * n for n in sizes], pa.string())))
    assert cuts() == []
    assert cuts(0, None, 0, 0) == [(0, 3), (3, 1)]
    assert cuts(4, 6, 1, 50, 1) == [(0, 2), (2, 1), (3, 1), (4, 1)]
