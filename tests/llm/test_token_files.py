"""Token files and their encoder against the library's plain call."""

import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from simsift.llm import tokenfiles as TF
from simsift.llm import vocabulary as V

PIECE_BPE = P.path("piece_bpe_32k.model")
BYTE_BPE = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string, ids int"
PIECES = [
    *"ab éß1 \n\t\r\x0b\x1c\x1f\x7f\x85\xa0    　'st.,!?-_文字́٣😀", "<|endoftext|>", "'s", "'ll",
    "  ", "\n\n", "word", " word", "x" * 70,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.mark.parametrize("plain_marks", [False, True])
def test_ids_equal_the_plain_call(library, plain_marks):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(6000)]
    coder = V.Encoder(BYTE_BPE, plain_marks, 3000)  # cleared many times on the way
    library.encode_special_tokens = plain_marks
    for a in range(0, len(texts), 500):
        flat, bounds = coder.ids([t.encode() for t in texts[a : a + 500]])
        for i, text in enumerate(texts[a : a + 500]):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_ids_around_every_character(library):
    """Each character of Unicode between letters, spaces, marks and line breaks, so that no cut falls wrong."""
    coder = V.Encoder(BYTE_BPE)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    texts = [f"a{c} b {c} .{c}\n{c}1{c}{c}  x" for c in letters]
    flat, bounds = coder.ids([t.encode() for t in texts])
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert all(flat[bounds[i] : bounds[i + 1]].tolist() == w.ids for i, w in enumerate(wanted))


def test_pieces_equal_the_plain_call():
    draw, model = random.Random(6), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    coder = V.PieceEncoder(PIECE_BPE)
    texts = ["".join(draw.choices([*PIECES, "▁", "<s>", "<0x0A>", "   "], k=draw.randint(1, 30))) for _ in range(5000)] + [" ", "  ", "a "]
    texts += [f"a{chr(c)} {chr(c)}b  {chr(c)}" for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(texts), 2000):
        part = texts[a : a + 2000]
        flat, bounds = coder.ids([b" " + t.encode() for t in part])
        for i, wanted in enumerate(model.encode(part)):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == wanted, part[i]


def brute(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, tmp_path, library):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choices(PIECES, k=draw.randint(0, 30)))) for i in range(-50, 300)]
    rows += [(400, None), (401, ""), (402, "long words " * 60_000), (2**62, "<|endoftext|> twice <|endoftext|>"), (None, "x")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(a, b, "clash", 7) for a, b in rows], SCHEMA).repartition(5)
    folder = f"file://{tmp_path}/out"
    TF.write_tokens(docs, folder, BYTE_BPE)
    back = TF.read_tokens(spark, folder).collect()
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, library)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in back)
    # the files themselves, by plain memory maps
    about = json.loads((tmp_path / "out/manifest.json").read_text())
    stream = np.concatenate([np.memmap(tmp_path / f"out/{p['name']}.ids", dtype="<u2", mode="r") for p in about["parts"] if p["n_ids"]])
    assert len(stream) == about["n_ids"] == sum(r.n_tokens for r in back)
    for p in about["parts"]:
        offsets = np.fromfile(tmp_path / f"out/{p['name']}.offsets", "<i8")
        assert len(offsets) == p["n_docs"] + 1 and offsets[-1] == p["n_ids"]
    assert sorted(f.suffix for f in Path(tmp_path / "out").iterdir() if f.suffix != ".json" and not f.name.startswith(".")) == sorted(
        [".ids", ".offsets", ".docs"] * len(about["parts"])
    )


def test_equal_doc_ids_spread_and_keep_their_places(spark, tmp_path):
    docs = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "'same text' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small ranges stay apart
    try:
        TF.write_tokens(docs, str(tmp_path / "ties"), BYTE_BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = TF.read_tokens(spark, str(tmp_path / "ties"), "doc_id bigint, start bigint, n_tokens bigint").orderBy("start").collect()
    assert [r.start for r in back] == [3 * i for i in range(6000)] and {r.n_tokens for r in back} == {3}
    assert [r.doc_id for r in back] == sorted(r.doc_id for r in back)
    about = json.loads((tmp_path / "ties/manifest.json").read_text())
    assert max(p["n_docs"] for p in about["parts"]) < 2000


def test_empty_table_and_folders_in_use(spark, tmp_path):
    folder = str(tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    TF.write_tokens(empty, folder, BYTE_BPE)
    assert TF.read_tokens(spark, folder).collect() == []
    with pytest.raises(Exception, match="already"):
        TF.write_tokens(empty, folder, BYTE_BPE)
    one = spark.createDataFrame([(1, "a", "", 0)], SCHEMA)
    TF.write_tokens(one, folder, BYTE_BPE, end_id=70_000, overwrite=True)
    assert [r.ids for r in TF.read_tokens(spark, folder).collect()] == [[64, 70_000]]


def test_failed_write_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "broken"
    bad = spark.range(20).selectExpr("id AS doc_id", "CASE WHEN id = 13 THEN raise_error('lost') ELSE 'x' END AS text")
    with pytest.raises(Exception, match="lost"):
        TF.write_tokens(bad, str(folder), BYTE_BPE)
    assert not folder.exists() or not [f for f in folder.iterdir() if f.suffix in (".json", ".ids", ".docs", ".offsets")]
    with pytest.raises(Exception, match="no finished token files"):
        TF.read_tokens(spark, str(folder)).collect()
