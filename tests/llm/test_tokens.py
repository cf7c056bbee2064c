import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer, normalizers

from mentionlab.llm import rangecoder, tokens


def expected(rows):
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_coder_round_trip():
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.2, n).clip(1, 50256) for n in (0, 1, 3, 700, 4096, 4096)] + [np.zeros(4096, int), np.array([131071, 0, 131071]), np.arange(4096) % 11]
    coded = rangecoder.encode(blocks)
    for want, got in zip(blocks, rangecoder.decode(coded, [len(b) for b in blocks])):
        assert np.array_equal(want, got)
    assert rangecoder.encode(blocks[:5])[4] == coded[4]  # a block's bytes don't depend on its company
    assert len(coded[6]) < 120 and len(coded[8]) < 400  # it learns
    with pytest.raises(ValueError):
        rangecoder.encode([np.array([131072])])


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, tokens.op6_tokens(spark, sf_dir).collect()))
    assert got == [e[:4] for e in expected(rows)]


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "é𝒳 <|endoftext|> x"), (2, "again"), (2, "again"), (None, "no id"), (9, "long text " * 30000), (-4, "below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ids").repartition(3)
    files = tokens.write_tokens(docs)
    got = sorted(map(tuple, tokens.read_tokens(files, with_ids=True).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0))).count() == 0


def test_damage_is_seen(spark, sf_dir):
    payload = bytearray(tokens.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)).first().payload)
    payload[-40] ^= 1
    with pytest.raises(ValueError):
        list(tokens.decode_segments([bytes(payload)]))


def pieces(end_id=0):
    return tokens.Pieces(Tokenizer.from_file(tokens.tokenizer_path()), end_id)


def spelled(held, texts):
    return [tokens.spell(*held.ids(), codes).tolist() for codes in held.of(pa.array(texts, pa.string()))]


def test_pieces_spell_what_the_tokenizer_gives():
    rng = random.Random(3)
    bits = ["a", "Ab", "don't", "'s", "'", "12", "é", "𝒳", "漢字", "_", "...", ".", "<|endoftext|>", "<|endof", *" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0　 ​᠎"]
    texts = ["".join(rng.choices(bits, [3] * 14 + [6] + [1] * 13, k=rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "a  b", "a \nb", "a\xa0 b", "a\xa0  b", "a\x1c  b", "don 't", "x" * 3000, "two words " * 500]
    tok, held = Tokenizer.from_file(tokens.tokenizer_path()), pieces(7)
    want = [[*tok.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert spelled(held, texts) == want
    assert spelled(held, texts[::-1]) == want[::-1]  # from memory
    held = held.renewed()
    assert 1 < held.n and spelled(held, texts) == want


def test_a_piece_is_tokenised_once():
    class Counting:
        def __init__(self, tok):
            self.tok, self.chars = tok, 0

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **more):
            self.chars += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **more)

    held = pieces()
    held.tok = tok = Counting(held.tok)
    spelled(held, ["some words again and again, " * 200 + "end"] * 50)
    assert tok.chars < 100


def test_a_tokenizer_that_looks_further_gets_whole_texts():
    for change in (lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t.pre_tokenizer, "add_prefix_space", True), lambda t: t.add_tokens([AddedToken("new york")]), lambda t: t.add_tokens([AddedToken("<x>", lstrip=True)])):
        tok = Tokenizer.from_file(tokens.tokenizer_path())
        assert tokens.divisible(tok)
        change(tok)
        held = tokens.Pieces(tok, 0)
        assert not held.divides
        texts = ["in New York, new york", "a  <x> b", "", " c"]
        assert spelled(held, texts) == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_more_pieces_than_the_coder_has_numbers():
    held, texts = pieces(), [" ".join(map(str, range(k, k + 70_000))) for k in (0, 70_000)]
    seg = tokens.Segment(0, held)
    want = []
    for k, codes in enumerate(held.of(pa.array(texts))):
        want.append(tokens.spell(*held.ids(), codes))
        seg.add(k, codes, len(want[-1]))
    ((keys, lengths, ids),) = tokens.decode_segments(tokens.encode_segments([seg]))
    assert held.n > 1 << rangecoder.ID_BITS and keys == [0, 1]
    assert np.array_equal(ids, np.concatenate(want)) and lengths.tolist() == [len(w) for w in want]


def test_any_damage_is_seen():
    held = pieces()
    seg = tokens.Segment(0, held)
    for k, codes in enumerate(held.of(pa.array(["the one and the other " * 40, "short"]))):
        seg.add(k, codes, int(held.ids()[1][codes].sum()))
    (payload,) = tokens.encode_segments([seg])
    first = 28 + sum(struct.unpack_from("<I", payload, at)[0] for at in (16, 24)) + 12
    want = [len(x) for x in spelled(held, ["the one and the other " * 40, "short"])]
    seen = 0
    for at in range(first, len(payload)):
        try:
            ((_, lengths, ids),) = tokens.decode_segments([payload[:at] + bytes([payload[at] ^ 64]) + payload[at + 1 :]])
            assert lengths.tolist() == want and ids.tolist() == sum(spelled(held, ["the one and the other " * 40, "short"]), [])
        except ValueError:
            seen += 1
    assert seen > (len(payload) - first) // 2  # the coder's last bits say nothing
