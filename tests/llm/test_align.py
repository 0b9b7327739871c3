"""Alignment of two tokenizers against plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from simsift.llm import align as A

SCHEMA = "doc_id bigint, text string, row string, a int, n_best string"
FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
PIECES = [
    *"abc éß1\n\t\x00　'.,-文字😀ﬁ́", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "  ", "the ", " tokenizer", "ing",
    "▁", "naïve ", "日本語", "\r\n", "x" * 40,
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def token_bytes(tools, ids, side):
    if side == "b":
        return [
            bytes([int(tools[1].id_to_piece(i)[3:-1], 16)]) if tools[1].is_byte(i) else tools[1].id_to_piece(i).replace("▁", " ").encode()
            for i in ids
        ]
    # a byte-level alphabet of its own: characters of the library's for every single byte
    letters = {c: i for i, c in enumerate(byte_letters())}
    return [bytes(letters[c] for c in tools[0].id_to_token(i)) for i in ids]


def byte_letters():
    from tokenizers import pre_tokenizers

    out = {}
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for char in map(chr, range(0x800)):
        shown = split.pre_tokenize_str(char)[0][0]
        out.update(zip(char.encode(), shown))
    for lead in range(0xE0, 0xF5):
        char = bytes([lead, 0x90, 0x80, *([0x80] if lead >= 0xF0 else [])]).decode(errors="ignore")
        if char:
            out.update(zip(char.encode(), split.pre_tokenize_str(char)[0][0]))
    return [out.get(i, f"none{i}") for i in range(256)]


def ranges(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows, tools):
    read, counts = [], Counter()
    for doc_id, text in rows:
        a = tools[0].encode(" " + (text or ""), add_special_tokens=False).ids
        b = tools[1].encode(text or "")
        pa, pb = token_bytes(tools, a, "a"), token_bytes(tools, b, "b")
        spelt = (" " + (text or "")).encode()
        if not text or b"".join(pa) != spelt or b"".join(pb) != spelt:
            read.append((doc_id, [], [], [], []))
            continue
        ra, rb = ranges(pa), ranges(pb)
        ends = sorted({y for _, y in ra} & {y for _, y in rb})
        links = [(i, j) for i, (_, x) in zip(a, ra) for j, (_, y) in zip(b, rb) if x == y]
        groups, low = [], 0
        for end in ends:
            groups.append(tuple([i for i, (x, y) in zip(ids, r) if low <= x and y <= end] for ids, r in ((a, ra), (b, rb))))
            low = end
        counts.update(links)
        read.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, a, b, groups, links in read:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links),
            sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if said else "",
        ))
    return sorted(out, key=repr)


def made(n, seed):
    draw = random.Random(seed)
    rows = [(i, "".join(draw.choices(PIECES, k=draw.randint(0, 25)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "ab " * 4000), (None, "the same"), (7, "the same"), (7, "the same")]


@pytest.mark.parametrize("known", [1, 40, 1 << 17])
def test_equals_brute_force(spark, tools, known):
    rows = made(250, known)
    docs = spark.createDataFrame([(x, t, "r", 1, "n") for x, t in rows], SCHEMA).repartition(3)
    got = A.aligned(docs, A.Pairing(*FILES, known)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, tools)


def test_overlaps_are_all_pairs_that_share_bytes(spark, tools):
    rows = made(120, 9)[:-2]
    docs = spark.createDataFrame([(x, t, "r", 1, "n") for x, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, A.token_overlaps(docs, A.Pairing(*FILES)).collect()), key=repr)
    wanted = []
    for doc_id, text in rows:
        a, b = tools[0].encode(" " + (text or ""), add_special_tokens=False).ids, tools[1].encode(text or "")
        pa, pb = token_bytes(tools, a, "a"), token_bytes(tools, b, "b")
        if text and b"".join(pa) == b"".join(pb) == (" " + text).encode():
            ra, rb = ranges(pa), ranges(pb)
            near = [(i, j) for i, x in enumerate(ra) for j in range(max(0, len(rb))) if (y := rb[j])[0] < x[1] and x[0] < y[1]] if len(text) < 500 else None
            if near is None:  # long: walk both sides at once
                near, j = [], 0
                for i, x in enumerate(ra):
                    while rb[j][1] <= x[0]:
                        j += 1
                    k = j
                    while k < len(rb) and rb[k][0] < x[1]:
                        near.append((i, k))
                        k += 1
            wanted += [(doc_id, i, j, a[i], b[j], *ra[i], *rb[j]) for i, j in near]
    assert got == sorted(wanted, key=repr)


def test_empty_table(spark):
    assert A.aligned(spark.createDataFrame([], SCHEMA), A.Pairing(*FILES)).collect() == []


def test_token_bytes_decode_as_the_library_does(tools):
    sides = A._sides(A.Pairing(*FILES))
    for text in ("naïve 日本語 \x00\x7f\xad ÿ", "plain words"):
        ids = tools[0].encode(text, add_special_tokens=False).ids
        assert b"".join(sides.a_bytes[i] for i in ids) == text.encode()
        assert decoders.ByteLevel().decode([tools[0].id_to_token(i) for i in ids]) == text
